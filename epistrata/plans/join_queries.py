"""Queries of joins with dimensions, intervals and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.operators import advantage, joins
from epistrata.plans.register import query, r
from epistrata.plans.views import EP, FR, episodes, frames, table, tasks, with_


@query(with_(FR) + "select i as \"index\", t.task from fr left join tasks t on t.task_index = fr.task")
def join_task_dim(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf)
    return joins.with_tasks(frames(spark, sf, "task_index"), t).select("index", "task")


@query("select task_index from (select task_index, row_number() over (order by task_index) - 1 as p from tasks) where p <> task_index")
def join_task_position(spark: SparkSession, sf: str) -> DataFrame:
    return joins.positional(tasks(spark, sf)).select("task_index")


@query(with_(FR, EP, "tm as (select tasks[1] as t, max(length) as m from eps group by 1)") + "select i as \"index\", length, label, m as max_length from fr join eps on eps.ep = fr.ep join tm on tm.t = tasks[1]")
def join_episode_meta(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf)
    e = e.withColumn("task", F.get("tasks", F.lit(0))).join(advantage.task_max_length(e), ["task"])
    return joins.with_episodes(frames(spark, sf), e, ["length", "label", "max_length"]).select("index", "length", "label", "max_length")


@query(with_(EP) + "select ep as episode_index, case when file % 3 = 0 then 1 else 9 end as dst_chunk, case when file % 3 = 0 then file // 3 else 7 end::bigint as dst_file from eps")
def join_src_to_dst(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).select("episode_index", F.col("`data/chunk_index`").alias("chunk_index"), F.col("`data/file_index`").alias("file_index"))
    files = e.select("chunk_index", "file_index").distinct().filter("file_index % 3 = 0").withColumn("dst_chunk", F.lit(1)).withColumn("dst_file", F.floor(F.col("file_index") / 3))
    return joins.file_destinations(e, files, (9, 7)).select("episode_index", "dst_chunk", F.col("dst_file").cast("bigint").alias("dst_file"))


_NEAR = "qs as (select distinct sample_id, episode_index as ep, timestamp as t from sensor_samples where timestamp is not null), nr as (select sample_id, i, ts, abs(qs.t - ts) as dt, row_number() over (partition by sample_id order by abs(qs.t - ts), ts, i) as rn from qs left join fr on fr.ep = qs.ep and ts is not null)"


@query(with_(FR, _NEAR) + "select sample_id as query_id, i as \"index\", round(dt, 6) as dt, coalesce(dt > 0.01, true) as is_pad from nr where rn = 1")
def join_asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "sensor_samples").select(F.col("sample_id").alias("query_id"), "episode_index", F.col("timestamp").alias("ts")).filter("ts is not null").distinct()
    out = joins.nearest_in_time(q, frames(spark, sf, "timestamp"), 0.01)
    return out.select("query_id", "index", r("dt", 6).alias("dt"), "is_pad")


@query(with_(FR, _NEAR) + "select count(*) as n from (select rn, dt, sample_id from nr where rn = 1 and dt > 0.01) x join qs on qs.sample_id = x.sample_id join (select ep, min(ts) as lo, max(ts) as hi from fr group by ep) s on s.ep = qs.ep where qs.t between lo and hi")
def scan_video_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Query times inside an episode that no frame is near enough to."""
    q = table(spark, sf, "sensor_samples").select(F.col("sample_id").alias("query_id"), "episode_index", F.col("timestamp").alias("ts")).filter("ts is not null").distinct()
    f = frames(spark, sf, "timestamp")
    return joins.out_of_tolerance(joins.nearest_in_time(q, f, 0.01), q, f).agg(F.count(F.lit(1)).alias("n"))


_SEGS = "sg as (select ep, segment, a * m - 0.05 as s, b * m + 0.05 as e from (select ep, max(ts) as m from fr group by ep) cross join (values ('start', 0.0, 0.3), ('middle', 0.3, 0.6), ('end', 0.6, 1.0)) t(segment, a, b))"


@query(with_(FR, _SEGS) + "select i as \"index\", segment from fr join sg on sg.ep = fr.ep and ts between s and e")
def join_range_segments(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "timestamp")
    m = f.groupBy("episode_index").agg(F.max("timestamp").alias("m"))
    sg = m.select("episode_index", F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), (F.lit(a) * F.col("m") - 0.05).alias("start"), (F.lit(b) * F.col("m") + 0.05).alias("end")) for n, a, b in (("start", 0.0, 0.3), ("middle", 0.3, 0.6), ("end", 0.6, 1.0))])).alias("s")).select("episode_index", "s.*")
    return joins.in_segments(f, sg).select("index", "segment")


@query(with_(FR, EP) + "select i as \"index\", coalesce(min(eps.ep), 0) as episode from fr left join eps on i >= f0 and i < f1 group by i")
def join_frame_to_episode(spark: SparkSession, sf: str) -> DataFrame:
    return joins.episode_of_index(frames(spark, sf).select("index"), episodes(spark, sf), width=512).select("index", "episode")


@query(with_(FR, EP) + "select fr.ep as episode_index, max(length) as length, round(min(ts), 5) as \"start\", round(max(ts), 5) as \"end\", count(*) as frames from fr join eps on eps.ep = fr.ep where ts is not null group by fr.ep")
def join_clip_ranges(spark: SparkSession, sf: str) -> DataFrame:
    c = joins.clip_ranges(frames(spark, sf, "timestamp"), episodes(spark, sf))
    return c.select("episode_index", "length", r("start").alias("start"), r("end").alias("end"), "frames")


@query(with_(FR) + "select i as \"index\", case when fi % 3 <> 2 then round(fi * 2.0 + 1, 3) end as value from fr")
def join_predictions(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index")
    p = f.filter("frame_index % 3 <> 2").select("index", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.col("frame_index").cast("double").alias("value")), F.struct(F.lit(1).alias("seq"), (F.col("frame_index") * 2.0 + 1).alias("value")))).alias("p")).select("index", "p.*")
    return joins.with_predictions(f, p).select("index", r("value", 3).alias("value"))


@query(with_(FR) + "select i as \"index\", round(adv, 5) as progress, min(i) over (partition by ep) as \"start\", max(i) over (partition by ep) + 1 as \"end\" from fr where adv is not null and not isnan(adv)")
def join_progress(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "advantage")
    return joins.with_progress(f, f.select("index", F.col("advantage").alias("progress"))).select("index", r("progress").alias("progress"), "start", "end")


_ANN = "an as (select ep, ep % 10 as k from eps), bd as (select fr.ep, 0.0 as lo, 3.0 as hi, k from fr join an on an.ep = fr.ep group by fr.ep, k)"


@query(with_(FR, EP, _ANN) + "select ep as episode_index, 'reach' as segment, greatest(lo, 0 - 0.5) as \"start\", least(hi, k + 0.5) as \"end\" from bd where k not in (0, 1)")
def join_annotation_json(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).withColumn("k", F.col("episode_index") % 10)
    bounds = frames(spark, sf).select("episode_index").distinct().join(e.select("episode_index"), ["episode_index"]).withColumns({"start_s": F.lit(0.0), "end_s": F.lit(3.0)})
    body = F.format_string('Sure:\n```json\n{"segments": [{"name": "reach", "start": "00:00", "end": "00:%02d", "confidence": %s}]}\n```', F.col("k").cast("int"), F.when(F.col("k") == 1, "0.1").otherwise("0.9"))
    ok, _ = joins.annotated_segments(e.select("episode_index", body.alias("annotation")), bounds, 0.5, 0.5, 0.5)
    return ok.select("episode_index", "segment", "start", "end")


@query(with_(FR, EP, _ANN) + "select case when k = 0 then 'empty segment' when k = 1 then 'low confidence' else 'missing annotation' end as reason, count(*) as n from bd where k in (0, 1, 2) group by 1")
def join_annotation_failures(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).withColumn("k", F.col("episode_index") % 10)
    bounds = frames(spark, sf).select("episode_index").distinct().join(e.select("episode_index"), ["episode_index"]).withColumns({"start_s": F.lit(0.0), "end_s": F.lit(3.0)})
    body = F.format_string('{"segments": [{"name": "reach", "start": "0", "end": "%d", "confidence": %s}]}', F.col("k"), F.when(F.col("k") == 1, "0.1").otherwise("0.9"))
    _, bad = joins.annotated_segments(e.filter("k <> 2").select("episode_index", body.alias("annotation")), bounds, 0.5, 0.5, 0.5)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(with_(EP) + "select repo_id as \"group\", robot_type as task, count(*) as value from eps where repo_id is not null and robot_type is not null group by 1, 2")
def cross_envs(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).filter("repo_id is not null and robot_type is not null").groupBy("repo_id", "robot_type").agg(F.count(F.lit(1)).alias("n"))
    inner = e.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("robot_type", "n"))).alias("m"))
    nested = inner.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("repo_id", "m"))).alias("x"))
    return joins.flatten_groups(nested, "x")
