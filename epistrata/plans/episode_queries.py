"""Queries of filters, columns, keys, tasks, splits, samples and set operations on episodes and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.functions import arrays, text
from epistrata.operators import episodes as ops
from epistrata.operators import joins
from epistrata.plans.register import query, r, sql_hash
from epistrata.plans.views import EP, FR, episodes, frames, table, tasks, with_

# --- filters and columns ---


@query(with_(FR) + "select i as \"index\" from fr where ep not in (1, 5, 8)")
def filter_episodes_list(spark: SparkSession, sf: str) -> DataFrame:
    ops.check_episodes(episodes(spark, sf), [1, 5, 8])
    return ops.drop_episodes(frames(spark, sf, "frame_index"), [1, 5, 8]).select("index")


@query(with_(FR) + "select i as \"index\" from fr where ep between 10 and 20")
def filter_episode_range(spark: SparkSession, sf: str) -> DataFrame:
    return ops.episode_range(frames(spark, sf, "frame_index"), 10, 20).select("index")


@query(with_(FR) + "select i as \"index\" from fr where coalesce(action[1], 0) <> 0 or coalesce(action[2], 0) <> 0")
def filter_zero_exact(spark: SparkSession, sf: str) -> DataFrame:
    return ops.drop_still_frames(frames(spark, sf, "action"), [0, 1]).select("index")


@query(with_(FR) + "select i as \"index\" from fr where greatest(coalesce(abs(action[1]::double), 0), coalesce(abs(action[2]::double), 0), coalesce(abs(action[3]::double), 0)) > 0.3")
def filter_zero_thresh(spark: SparkSession, sf: str) -> DataFrame:
    return ops.drop_still_frames(frames(spark, sf, "action"), [0, 1, 2], 0.3).select("index")


@query(with_(FR, "m as (select i, sqrt(coalesce(action[1]::double * action[1]::double, 0) + coalesce(action[2]::double * action[2]::double, 0)) as n from fr)") + "select i as \"index\", round(n, 5) as motion from m where n >= 0.4")
def filter_motion_norm(spark: SparkSession, sf: str) -> DataFrame:
    return ops.motion_at_least(frames(spark, sf, "action"), [0, 1, 20], 0.4).select("index", r("motion").alias("motion"))


@query(with_(FR, "k as (select ep, count(*) as total, count(case when coalesce(action[1], 0) > 0.3 or coalesce(action[1], 0) < -0.3 then 1 end) as kept from fr group by ep)") + "select ep as episode_index, total, kept, total - kept as removed from k")
def agg_zero_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action")
    kept = ops.drop_still_frames(f.withColumn("action", F.transform("action", lambda x: x.cast("double"))), [0], float.fromhex("0x1.333334p-2"))
    return ops.removed_summary(f, kept)


@query(with_(EP) + "select case when label in ('success', 'true', '1', 's') then 'success' when label in ('failure', 'false', '0', 'f') then 'failure' else label end as outcome, count(*) as n from eps group by 1")
def filter_success(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).groupBy(text.outcome(F.col("episode_success")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values ('complementary_info.advantage_v1'), ('complementary_info.collector_policy_id'), ('complementary_info.is_intervention'), ('observation.state')) t(name)")
def filter_feature_patterns(spark: SparkSession, sf: str) -> DataFrame:
    names = ops.matching_columns(table(spark, sf, "frames"), ["^state$", "^(adv|coll|is_)"], ["observation.", "complementary_info."])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("select distinct \"index\", episode_index, frame_index, task_index from frames")
def project_remove_feature(spark: SparkSession, sf: str) -> DataFrame:
    f = ops.remove_features(table(spark, sf, "frames"), ["action", "observation.state", "complementary_info.advantage_v1", "complementary_info.is_intervention", "complementary_info.collector_policy_id", "ingested_at"])
    return f.select("index", "episode_index", "frame_index", "task_index").distinct()


@query(with_(FR) + "select i as \"index\", fi * 2 as twice, case when adv > 0 then adv end as gain from fr where adv is null or not isnan(adv)")
def project_add_feature(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "advantage").filter("advantage is null or not isnan(advantage)")
    values = f.select("index", F.when(F.col("advantage") > 0, F.col("advantage")).alias("gain"))
    return ops.add_by_index(f.withColumn("twice", F.col("frame_index") * 2), values, ["gain"]).select("index", "twice", "gain")


@query(with_(FR) + "select i as \"index\", fi + 1 as next_frame from fr")
def project_modify_features(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "advantage")
    return ops.modify_features(f, {"next_frame": F.col("frame_index") + 1}, ["advantage"]).select("index", "next_frame")


@query(with_(FR) + "select i as \"index\", round(adv, 5) as \"complementary_info.adv\" from fr where adv is not null and not isnan(adv)")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "advantage").filter("advantage is not null and not isnan(advantage)").withColumn("advantage", r("advantage"))
    return ops.rename_columns(f, {"advantage": "complementary_info.adv"}).drop("episode_index")


@query("select distinct \"index\", episode_index, frame_index, task_index from frames")
def project_strip_complementary(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "frames")
    kept = f.select(*[f"`{n}`" for n in f.columns if not n.startswith("complementary_info.")])
    return kept.select("index", "episode_index", "frame_index", "task_index").distinct()


@query(with_(FR) + "select i as \"index\", d, case when d = 0 then fi else ep end::double as x from fr, (select unnest(range(0, 2)) as d)")
def project_frame_build(spark: SparkSession, sf: str) -> DataFrame:
    f = ops.pack(frames(spark, sf, "frame_index"), ["frame_index", "episode_index"], "v")
    return f.select("index", F.posexplode("v").alias("d", "x")).select("index", F.col("d").cast("bigint").alias("d"), F.col("x").cast("double").alias("x"))


@query(with_(FR) + "select i as \"index\", round(action[1]::double, 5) as pan, round(action[6]::double, 5) as gripper from fr")
def project_frame_unpack(spark: SparkSession, sf: str) -> DataFrame:
    f = ops.unpack(frames(spark, sf, "action"), "action", ["pan", "lift", "flex", "roll", "yaw", "gripper"])
    return f.select("index", r(F.col("pan").cast("double")).alias("pan"), r(F.col("gripper").cast("double")).alias("gripper"))


@query("select distinct \"index\", round(\"observation.state\"[1]::double, 5) as x, 0.0 as reward, false as done, \"complementary_info.is_intervention\"::double as iv from frames")
def project_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Flat rows to transitions and back."""
    f = table(spark, sf, "frames").dropDuplicates(["index"])
    back = ops.from_transition(ops.to_transition(f))
    return back.select("index", r(arrays.at(F.col("`observation.state`"), 0)).alias("x"), F.col("`next.reward`").alias("reward"), F.col("`next.done`").alias("done"), F.col("`complementary_info.is_intervention`").cast("double").alias("iv"))


@query(with_(FR) + "select i as \"index\", 0.0 as state, d, 0.0 as x from fr, (select unnest(range(0, 3)) as d)")
def project_patch_schema(spark: SparkSession, sf: str) -> DataFrame:
    f = ops.patch_features(frames(spark, sf, "frame_index"), {"complementary_info.state": ("double", 1), "complementary_info.policy_action": ("double", 3), "frame_index": ("int", 1)})
    return f.select("index", F.col("`complementary_info.state`").alias("state"), F.posexplode("`complementary_info.policy_action`").alias("d", "x")).withColumn("d", F.col("d").cast("bigint"))


@query(with_(FR) + "select i as \"index\", round(action[1]::double, 5) as x, 0.0 as extra from fr where len(action) = 6")
def project_legacy_convert(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action", "collector").filter(F.size("action") == 6)
    g = ops.convert_legacy(f, {"action": 6}, ["collector"], {"extra": ("double", 1)})
    return g.select("index", r(arrays.at(F.col("action"), 0)).alias("x"), "extra")


@query(with_(EP) + "select ep as episode_index, case when ep in (1, 2, 3) then 'success' when ep in (4, 5) then 'failure' else 'unknown' end as outcome from eps")
def project_success_label(spark: SparkSession, sf: str) -> DataFrame:
    return ops.label_success(episodes(spark, sf), [1, 2, 3], [4, 5], "unknown", "outcome").select("episode_index", "outcome")


@query(with_(EP) + "select ep as episode_index, case when label in ('success', 'failure') then label else 'failure' end as outcome from eps where label in ('success', 'failure') or label is null or label = ''")
def project_resolve_success(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).filter("label in ('success', 'failure') or label is null or label = ''")
    return e.select("episode_index", ops.resolved_label(F.col("episode_success"), "failure").alias("outcome"))


@query(with_(FR) + "select i as \"index\", case when fi % 2 = 0 then case when coalesce(iv, 0) > 0.5 then 'human' else 'policy' end when collector is not null then 'policy' else 'human' end as who from fr")
def project_collector(spark: SparkSession, sf: str) -> DataFrame:
    who = ops.collector(F.col("frame_index") % 2 == 0, F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5, F.col("collector").isNotNull(), F.lit("policy"), F.lit("human"))
    return frames(spark, sf, "frame_index", "intervention", "collector").select("index", who.alias("who"))


@query("select 'set_20260101_v' || lpad(cast(max(episode_index) % 50 + 1 as varchar), 2, '0') as version from (select max(episode_index % 50) as episode_index from episodes)")
def project_auto_version(spark: SparkSession, sf: str) -> DataFrame:
    names = episodes(spark, sf).select(F.format_string("set_20260101_v%02d", (F.col("episode_index") % 50).cast("int")).alias("name"))
    return ops.next_version(names, "set", "20260101")


# --- keys ---

_KEPT = "kept as (select i, ep, fi from fr where ep % 3 <> 0)"
_LEN = "len as (select ep, count(*) as n from kept group by ep)"
_NEW = "nw as (select ep, row_number() over (order by ep) - 1 as ne, sum(n) over (order by ep) - n as base, n from len)"


@query(with_(FR, _KEPT, _LEN, _NEW) + "select i as old_index, ne as episode_index, base + row_number() over (partition by kept.ep order by fi, i) - 1 as \"index\" from kept join nw on nw.ep = kept.ep")
def reindex_dense(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index").filter("episode_index % 3 <> 0").withColumn("old_index", F.col("index"))
    return ops.reindex(f).select("old_index", "episode_index", "index")


@query(with_(FR, _KEPT, _LEN, _NEW) + "select ep as old_episode, ne as new_episode, base as from_index, base + n as to_index from nw")
def reindex_meta(spark: SparkSession, sf: str) -> DataFrame:
    lengths = frames(spark, sf).filter("episode_index % 3 <> 0").groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return ops.dense_episodes(lengths).select(F.col("episode_index").alias("old_episode"), F.col("new_index").alias("new_episode"), "from_index", "to_index")


_VID = "v as (select ep, ep // 10 as f, length / 30.0 as s, sum(length / 30.0) over (partition by ep // 10 order by ep) as t1, ep % 4 <> 1 or ep // 10 % 2 = 0 as keep from eps)"


@query(with_(EP, _VID, "w as (select *, bool_and(keep) over (partition by f) as whole from v)") + "select ep as episode_index, round(case when whole then t1 - s else sum(s) over (partition by f order by ep) - s end, 4) as from_timestamp, round(case when whole then t1 else sum(s) over (partition by f order by ep) end, 4) as to_timestamp from w where keep")
def reindex_videos(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = episodes(spark, sf).select("episode_index", F.lit(0).alias("chunk_index"), F.floor(F.col("episode_index") / 10).alias("file_index"), "length", F.lit(30.0).alias("fps"))
    t1 = F.sum(F.col("length") / 30.0).over(Window.partitionBy("file_index").orderBy("episode_index"))
    e = e.withColumn("to_timestamp", t1).withColumn("from_timestamp", t1 - F.col("length") / 30.0)
    out = ops.video_spans(e, e.filter("episode_index % 4 <> 1 or file_index % 2 = 0"))
    return out.select("episode_index", r("from_timestamp", 4).alias("from_timestamp"), r("to_timestamp", 4).alias("to_timestamp"))


@query(with_(FR, "a as (select i, ep, 0 as part from fr where ep % 2 = 0 union all select i, ep, 1 from fr where ep % 2 = 1)", "m as (select max(ep) as e, max(i) as x from fr where ep % 2 = 0)") + "select part, i as old_index, i + case when part = 1 then x + 1 else 0 end as \"index\", ep + case when part = 1 then e + 1 else 0 end as episode_index from a, m")
def reindex_merge(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index").withColumn("old_index", F.col("index"))
    a = f.filter("episode_index % 2 = 0")
    m = a.agg(F.max("episode_index").alias("e"), F.max("index").alias("x")).first()
    b = ops.shift_after(m["x"], m["e"], f.filter("episode_index % 2 = 1"))
    return ops.union_checked(a.withColumn("part", F.lit(0)), b.withColumn("part", F.lit(1))).select("part", "old_index", "index", "episode_index")


@query(with_(FR) + "select i as \"index\", s as task_index from fr join (values (0, 0, 9), (1, 10, 30), (2, 25, 60)) t(s, a, b) on fi between a and b")
def reindex_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Segment datasets in declared order under one roof: the task is the segment's place."""
    f = frames(spark, sf, "frame_index")
    out = None
    for s, (a, b) in enumerate([(0, 9), (10, 30), (25, 60)]):
        part = f.filter(F.col("frame_index").between(a, b)).select("index", F.lit(s).alias("task_index"))
        out = part if out is None else ops.union_checked(out, part)
    return out


@query(with_(FR, "m as (select max(i) + 1 as n from fr)") + "select i as \"index\", i % 500 as slot from fr, m where i >= n - 500")
def reindex_online(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    n = f.agg(F.max("index")).first()[0] + 1
    return ops.ring_keep(f, 500, n).select("index", "slot")


@query("with n as (select distinct trim(task) || ' again' as task from tasks where task_index < 5) select task, task_index from tasks union all select task, (select max(task_index) from tasks) + row_number() over (order by task) from n")
def task_upsert(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf)
    new = t.filter("task_index < 5").select(F.concat(F.trim("task"), F.lit(" again")).alias("task")).unionByName(t.select("task"))
    return ops.upsert_tasks(t, new)


@query(with_(EP, "t as (select ep, case when ep % 7 = 0 then 'override ' || (ep % 3) else tasks[1] end as task from eps)") + "select ep as episode_index, task, dense_rank() over (order by task) - 1 as task_index from t where task is not null")
def task_modify(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf)
    over = e.filter("episode_index % 7 = 0").select("episode_index", F.concat(F.lit("override "), (F.col("episode_index") % 3).cast("string")).alias("task"))
    return ops.retask(e, None, over).filter("task is not null")


@query(with_(FR) + "select i + 1000000 as \"index\", ep + 100000 as episode_index, 59 - task as task_index from fr where task between 0 and 59")
def join_task_rekey(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf)
    target = t.select("task", (59 - F.col("task_index")).alias("task_index"))
    f = frames(spark, sf, "task_index").filter("task_index between 0 and 59")
    return ops.rekey_tasks(f, t, target, 100_000, 1_000_000).select("index", "episode_index", "task_index")


@query("with s as (select task, min(task_index + 100 * (task_index % 2)) as k from tasks group by task) select task, row_number() over (order by k) - 1 as task_index from s")
def agg_unique_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf)
    src = t.select((F.col("task_index") % 2).cast("int").alias("source_no"), "task_index", "task")
    return ops.first_seen_tasks(src.unionByName(src.withColumn("source_no", F.lit(3))))


@query("select task_index, task from tasks where contains(lower(task), 'fold') order by task_index limit 1")
def find_task(spark: SparkSession, sf: str) -> DataFrame:
    return ops.find_task(tasks(spark, sf), "FOLD").select("task_index", "task")


# --- splits and samples ---

_N = "n as (select count(*) as n from eps)"


@query(with_(EP, _N, "p as (select ep, row_number() over (order by ep) - 1 as pos from eps)") + "select ep as episode_index, case when pos < floor(n * 0.8) then 'train' when pos < floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end as split from p, n")
def split_fractions(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf)
    ranges = ops.fraction_ranges(e.count(), {"train": 0.8, "val": 0.1, "test": 0.1})
    return ops.dense_episodes(e).select("episode_index", ops.split_column(F.col("new_index"), ranges).alias("split"))


@query(with_(FR, "m as (select max(i) + 1 as n from fr)") + "select i as \"index\", cast(floor(i / ceil(n / 7.0)) as integer) as shard from fr, m")
def shard_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    n = f.agg(F.max("index")).first()[0] + 1
    return ops.padded_shards(f, n, 7).distinct().join(f.select("index"), ["index"], "left_semi").select("index", "shard").dropDuplicates(["index"])


@query(with_(FR, "m as (select max(i) + 1 as n from fr)", "k as (select n, greatest(least(100, n), least(cast(floor(n ** 0.75) as bigint), 10000)) as k from m)", "s as (select distinct cast(round_even(j * (n - 1) / (k - 1)::double, 0) as bigint) as i from k, (select unnest(range(0, 10001)) as j) where j < k)") + "select fr.i as \"index\" from fr join s on s.i = fr.i")
def sample_even(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    n = f.agg(F.max("index")).first()[0] + 1
    return f.filter(ops.even_sample_column(F.col("index"), n)).select("index")


@query("select vec_id, d, round(embedding[d * 4 + 1]::double, 5) as x from embeddings, (select unnest(range(0, 16)) as d)")
def sample_downsample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).filter("p % 4 = 0")
    return e.select("vec_id", (F.col("p") / 4).cast("bigint").alias("d"), r(F.col("x").cast("double")).alias("x"))


@query(f"select task_index from tasks where task_index % 4 > 0 order by -ln(({sql_hash('task_index', 5)} + 0.5) / 4503599627370496.0) / (task_index % 4), task_index limit 10")
def sample_random_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Ten of the tasks without replacement, by weights 0 to 3."""
    t = tasks(spark, sf).withColumn("w", (F.col("task_index") % 4).cast("double"))
    return ops.weighted_subset(t, "w", "task_index", 10, 5).select("task_index")


@query(with_(FR, f"h as (select ep, i, row_number() over (partition by ep order by {sql_hash('i', 9)}, i) as k, count(*) over (partition by ep) as n from fr)") + "select ep as episode_index, i as \"index\" from h where k <= greatest(1, floor(n * 0.25))")
def sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ops.hash_sample(frames(spark, sf), "episode_index", ["index"], 0.25, 9).select("episode_index", "index")


@query(with_(FR, "m as (select max(i) + 1 as n from fr)", f"d as (select k as draw, {sql_hash('k', 3)} % n as i from m, (select unnest(range(0, 256)) as k))") + "select draw, d.i as \"index\", fi as frame_index from d join fr on fr.i = d.i")
def sample_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of 256 draws with replacement; a draw of a lost frame gives none."""
    f = frames(spark, sf, "frame_index")
    n = f.agg(F.max("index")).first()[0] + 1
    return ops.replay_sample(f, n, 256, 3).select("draw", "index", "frame_index")


@query(with_(FR, "m as (select i, ep, fi, sqrt(action[1]::double * action[1]::double + action[2]::double * action[2]::double) as n from fr where task = 3)", "t as (select i from m order by n desc, i limit 50)") + "select i as \"index\" from t")
def topk_motion(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: the 50 frames of task 3 that move most."""
    f = ops.motion_at_least(frames(spark, sf, "action", "task_index").filter("task_index = 3"), [0, 1], 0.0)
    return f.orderBy(F.desc("motion"), "index").limit(50).select("index")


@query("select * from (values ('front_left', 1), ('wrist', 2)) t(camera, rank)")
def pick_camera(spark: SparkSession, sf: str) -> DataFrame:
    cams = {"wrist": (480, 640), "front_left": (240, 320)}
    first = ops.pick_camera(cams)
    return spark.createDataFrame([(first, 1), (ops.pick_camera({k: v for k, v in cams.items() if k != first}), 2)], "camera string, rank int")


@query(with_(EP) + "select ep as episode_index from eps where ep between 0 and 3 or ep = 8 or ep between 20 and 90")
def parse_episode_spec(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).filter(ops.in_ranges(ops.parse_episode_spec("0-2, 8,3,1, 20-70,60-90"))).select("episode_index")


# --- set operations ---

#: Greedy packing as a recursion over the files of each repo.
PACKED = """with recursive o as (select repo_id, file_id, size_bytes::double as s, row_number() over (partition by repo_id order by file_id) as r from (select distinct repo_id, file_id, size_bytes from small_files where repo_id is not null)),
g as (select repo_id, r, file_id, s, 0 as k, 0.0::double as used from o where r = 1 union all
  select o.repo_id, o.r, o.file_id, o.s, case when g.used + g.s + o.s >= {most} then g.k + 1 else g.k end, case when g.used + g.s + o.s >= {most} then 0 else g.used + g.s end from g join o on o.repo_id = g.repo_id and o.r = g.r + 1)
select repo_id as dataset, file_id as file_no, (k // {chunk})::bigint as dst_chunk, (k % {chunk})::bigint as dst_file, used as "offset" from g"""


def packed(spark: SparkSession, sf: str, most: float, chunk: int) -> DataFrame:
    files = table(spark, sf, "small_files").filter("repo_id is not null").select(F.col("repo_id").alias("dataset"), F.col("file_id").alias("file_no"), F.col("size_bytes").alias("size")).distinct()
    return ops.destination_files(files, most, chunk)


@query(with_(FR, "m as (select max(dataset_to_index) as x, max(episode_index) as e from episodes where episode_index % 2 = 0)", "u as (select i, ep, task from fr where ep % 2 = 0 union all select i + x, ep + e + 1, task from fr, m where ep % 2 = 1)") + "select i as \"index\", ep as episode_index, task as task_index from u where task between 0 and 59")
def union_datasets(spark: SparkSession, sf: str) -> DataFrame:
    f, e, t = frames(spark, sf, "task_index").filter("task_index between 0 and 59"), episodes(spark, sf), tasks(spark, sf)
    half = lambda d, k: d.filter(F.col("episode_index") % 2 == k)
    merged, _ = ops.merge_datasets([(half(f, 0), half(e, 0), t), (half(f, 1), half(e, 1), t)])
    return merged.select("index", "episode_index", "task_index")


@query(PACKED.format(most=9000, chunk=2))
def union_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Where each source file goes when the files of a dataset are joined into larger ones."""
    return packed(spark, sf, 9000.0, 2)


@query(with_(FR, "m as (select max(dataset_to_index) as x, max(episode_index) as e from episodes where episode_index % 2 = 0)", "u as (select i, ep, task from fr where ep % 2 = 0 union all select i + x, ep + e + 1, task from fr, m where ep % 2 = 1)") + "select i as \"index\", ep as episode_index, t.task as text from u join tasks t on t.task_index = u.task")
def union_merge_api(spark: SparkSession, sf: str) -> DataFrame:
    """Merged frames with the text of their task, whose number the merge may change."""
    f, e, t = frames(spark, sf, "task_index").filter("task_index between 0 and 59"), episodes(spark, sf), tasks(spark, sf)
    half = lambda d, k: d.filter(F.col("episode_index") % 2 == k)
    merged, target = ops.merge_datasets([(half(f, 0), half(e, 0), t), (half(f, 1), half(e, 1), t.withColumn("task_index", F.col("task_index")))])
    return merged.join(target.select("task_index", F.col("task").alias("text")), ["task_index"]).select("index", "episode_index", "text")


@query("select episode_index, 0 as dataset_index, count(*) as n from (select distinct episode_index, \"index\" from frames) group by 1 union all select episode_index, 1, count(*) from sensor_samples group by 1")
def union_intersect_cols(spark: SparkSession, sf: str) -> DataFrame:
    u = ops.union_intersection([frames(spark, sf).drop("index"), table(spark, sf, "sensor_samples")])
    return u.groupBy("episode_index", "dataset_index").agg(F.count(F.lit(1)).alias("n"))


@query(with_(FR) + "select i as \"index\", fi as a, null::bigint as b from fr where ep % 2 = 0 union all select i, null, task from fr where ep % 2 = 1")
def union_transitions(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "task_index")
    return ops.union_transitions(f.filter("episode_index % 2 = 0").select("index", F.col("frame_index").alias("a")), f.filter("episode_index % 2 = 1").select("index", F.col("task_index").alias("b")))


@query("select * from (values ('missing', 'reward'), ('extra', 'collector_id')) t(kind, name)")
def except_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index").withColumn("collector_id", F.lit(1))
    missing, extra = ops.feature_gaps(f, ["index", "episode_index", "frame_index", "reward"])
    return spark.createDataFrame([("missing", n) for n in missing] + [("extra", n) for n in extra], "kind string, name string")


@query(with_(FR) + "select i as \"index\" from fr where fi % 5 = 4")
def except_missing_preds(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index")
    return ops.missing_rows(f, f.filter("frame_index % 5 <> 4"))


@query(with_(EP) + "select ep as episode_index from eps where ep < 20 intersect select ep from eps where ep > 10")
def intersect_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).select("episode_index")
    return e.filter("episode_index < 20").intersect(e.filter("episode_index > 10"))


@query(with_(FR) + "select i as \"index\" from fr where ep in (select ep from (select episode_index as ep from episodes where lower(trim(episode_success)) = 'success'))")
def semi_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return joins.frames_of_kept(frames(spark, sf), episodes(spark, sf).filter("label = 'success'")).select("index")
