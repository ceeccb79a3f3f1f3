"""Queries of scans and sinks: the test tables are written in the dataset layout and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.operators import episodes as ops
from epistrata.operators import metrics, windows
from epistrata.plans.episode_queries import PACKED, packed
from epistrata.plans.register import query, r
from epistrata.plans.views import EP, FR, episodes, frames, table, tasks, with_
from epistrata.runtime import Workspace
from epistrata.sources import dataset

FEATURES = {
    "index": {"dtype": "int64", "shape": (1,), "names": None}, "episode_index": {"dtype": "int64", "shape": (1,), "names": None}, "frame_index": {"dtype": "int64", "shape": (1,), "names": None},
    "timestamp": {"dtype": "float64", "shape": (1,), "names": None}, "task_index": {"dtype": "int64", "shape": (1,), "names": None}, "action": {"dtype": "float32", "shape": (6,), "names": None}, "top": {"dtype": "video", "shape": (48, 64, 3), "names": None},
}


def _written(spark: SparkSession, sf: str) -> str:
    """The test tables as a dataset on disk."""
    root = Workspace(spark, "dataset").path("root")
    f = frames(spark, sf, "frame_index", "timestamp", "task_index", "action")
    dataset.write_frames(f, root, 5000)
    e = episodes(spark, sf).select("episode_index", "tasks", "length").withColumn("stats/action/count", F.col("length"))
    stats = {"action": {"mean": [0.5] * 6, "count": [3]}, "top": {"mean": [0.1, 0.2, 0.3]}}
    dataset.write_meta(spark, root, {"fps": 30, "features": {k: {**v, "shape": list(v["shape"])} for k, v in FEATURES.items()}}, tasks(spark, sf).withColumnRenamed("task", "__index_level_0__"), dataset.episode_rows(e), stats)
    return root


@query(with_(FR) + "select i as \"index\", fi as frame_index, round(action[1]::double, 5) as x from fr where ep in (3, 4, 90)")
def scan_frames(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.scan_frames(spark, _written(spark, sf), FEATURES, episodes=[3, 4, 90], columns=["index", "episode_index", "frame_index", "action"])
    return df.select("index", "frame_index", r(F.get("action", F.lit(0)).cast("double")).alias("x"))


@query(with_(FR) + "select ep as episode_index, count(*) as n from fr where ep in (3, 4) group by ep")
def scan_frames_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of episodes whose frames and videos are there."""
    root = _written(spark, sf)
    places = episodes(spark, sf).filter("episode_index in (3, 4)").select("episode_index", F.lit(0).alias("chunk_index"), F.floor(F.col("episode_index") / 100).cast("int").alias("file_index"))
    _put(spark, f"{root}/videos/top/chunk-000/file-000.mp4", b"x")
    return dataset.scan_frames_checked(spark, root, [3, 4], videos=places, video_keys=["top"]).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))


@query(with_(EP) + "select ep as episode_index, length, sum(length) over (order by ep)::bigint - length as dataset_from_index, 0 as stats_columns from eps")
def scan_episodes(spark: SparkSession, sf: str) -> DataFrame:
    e = dataset.scan_episodes(spark, _written(spark, sf))
    return e.select("episode_index", "length", "dataset_from_index", F.lit(sum(n.startswith("stats/") for n in e.columns)).alias("stats_columns"))


@query(with_(EP) + "select ep as episode_index, length as n from eps where ep = 7")
def scan_episode_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.scan_episodes(spark, _written(spark, sf), stats=True, episode=7).select("episode_index", F.col("`stats/action/count`").alias("n"))


@query("select task_index, task, false as has_subtasks from tasks")
def scan_tasks(spark: SparkSession, sf: str) -> DataFrame:
    root = _written(spark, sf)
    return dataset.scan_tasks(spark, root).select("task_index", "task", F.lit(dataset.scan_tasks(spark, root, "subtasks") is not None).alias("has_subtasks"))


@query(with_(FR) + "select 'action' as feature, s as stat, d::integer as dim, round(case s when 'mean' then avg(action[d + 1]::double) when 'min' then min(action[d + 1]::double) else max(action[d + 1]::double) end, 5) as value from fr, (select unnest(range(0, 6)) as d), (values ('mean'), ('min'), ('max')) t(s) where len(action) = 6 group by s, d union all select 'top', 'mean', d::integer, 0.1 + 0.1 * d from (select unnest(range(0, 3)) as d)")
def scan_info_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the actions and those copied for a camera, through stats.json."""
    f = frames(spark, sf, "action").filter(F.size("action") == 6)
    one = f.agg(*[k(F.get("action", F.lit(i)).cast("double")).alias(f"{n}{i}") for n, k in (("mean", F.avg), ("min", F.min), ("max", F.max)) for i in range(6)]).first()
    root = Workspace(spark, "stats").path("root")
    told = {"action": {n: [one[f"{n}{i}"] for i in range(6)] for n in ("mean", "min", "max")}, "top": {"mean": [0.1, 0.2, 0.30000000000000004]}}
    dataset.write_meta(spark, root, {"fps": 30, "features": {"action": {**FEATURES["action"], "shape": [6]}}}, tasks(spark, sf), episodes(spark, sf).select("episode_index", "tasks", "length"), told)
    assert dataset.scan_info(spark, root)["features"]["action"]["shape"] == (6,)
    return dataset.scan_stats(spark, root).withColumn("value", r("value"))


@query(with_(FR) + "select i as \"index\", task as task_index from fr")
def scan_subset_columns(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.scan_frames(spark, _written(spark, sf), FEATURES, columns=["index", "task_index"])


@query(with_(FR) + "select i as \"index\", row_number() over (partition by ep order by fi, i) as pos from fr where action is not null")
def scan_tracking(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    df = dataset.scan_frames(spark, _written(spark, sf), FEATURES, columns=["index", "episode_index", "frame_index", "action"]).filter("action is not null")
    return df.select("index", F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index", "index")).cast("bigint").alias("pos"))


@query(with_(FR) + "select count(*)::bigint as rows, true as sized from fr")
def scan_rowcount(spark: SparkSession, sf: str) -> DataFrame:
    s = dataset.scan_sizes(spark, f"{_written(spark, sf)}/data")
    return s.agg(F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("sized"))


@query(with_(EP) + "select ep as episode_index, length, len(tasks) as n_tasks from eps")
def scan_legacy(spark: SparkSession, sf: str) -> DataFrame:
    path = Workspace(spark, "legacy").path("episodes.jsonl")
    episodes(spark, sf).select("episode_index", "tasks", "length").write.json(path)
    return dataset.scan_jsonl(spark, path, "episode_index long, tasks array<string>, length long").select("episode_index", "length", F.size("tasks").cast("bigint").alias("n_tasks"))


@query(with_(FR) + "select ep as episode_index, count(*) as n from fr group by ep")
def scan_stream_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All data files as a stream, a few a batch, into a table."""
    from epistrata.streaming import queues

    root = _written(spark, sf)
    ws = Workspace(spark, "shards")
    out, cp = ws.path("out"), ws.path("checkpoint")
    queues.run_to_table(dataset.stream_frames(spark, root, FEATURES, 2).select("index", "episode_index"), out, cp)
    return spark.read.parquet(out).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))


def _ported(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes nested as arrays of steps come out as frames with joined vectors."""
    f = frames(spark, sf, "frame_index", "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))
    nested = f.groupBy("episode_index").agg(F.sort_array(F.collect_list(F.struct("frame_index", "index", "action", "state"))).alias("steps"))  # the nested source
    flat = dataset.nested_episodes_to_frames(nested, "steps", {"v": ["action", "state"]}, [], ["index"])
    return flat.select("episode_index", "index", F.posexplode("v").alias("d", "x")).select("episode_index", "index", F.col("d").cast("bigint").alias("d"), r(F.col("x").cast("double")).alias("x"))


@query(with_(FR) + "select i as \"index\", d, round(case when d < 6 then action[d + 1] else state[d - 5] end::double, 5) as x from fr, (select unnest(range(0, 12)) as d) where len(action) = 6 and len(state) = 6")
def scan_rlds_port(spark: SparkSession, sf: str) -> DataFrame:
    return _ported(spark, sf).drop("episode_index")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


@query("select 'img' || lpad(task_index::varchar, 3, '0') || '.bin' as name, octet_length(encode(task)) as bytes from (select *, row_number() over (order by task_index) - 1 as p from tasks) where p % 2 = 0")
def scan_images(spark: SparkSession, sf: str) -> DataFrame:
    """Every other file by its place in path order; one file a task, with its text."""
    path = Workspace(spark, "images").path("in")
    rows = tasks(spark, sf).collect()
    for x in rows:
        _put(spark, f"{path}/img{x['task_index']:03d}.bin", x["task"].encode())
    picked = dataset.scan_images(spark, path, range(0, len(rows), 2))
    return picked.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.octet_length("content").alias("bytes"))


# --- sinks ---


@query(with_(FR) + "select i as \"index\", ep as episode_index from fr")
def sink_frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.scan_frames(spark, _written(spark, sf), FEATURES, columns=["index", "episode_index"])


@query(with_(EP) + "select ep as episode_index, sum(length) over (order by ep)::bigint - length as dataset_from_index, sum(length) over (order by ep)::bigint as dataset_to_index from eps")
def sink_episode_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.episode_rows(episodes(spark, sf).select("episode_index", "length")).select("episode_index", "dataset_from_index", "dataset_to_index")


@query(PACKED.format(most=20000, chunk=3))
def sink_rotating(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf, 20_000.0, 3)


@query(with_(FR) + "select i as \"index\", case when i % 2 = 0 then fi * 10.0 else -1.0 end as value, fi as frame_index from fr")
def sink_columns_inplace(spark: SparkSession, sf: str) -> DataFrame:
    root = _written(spark, sf)
    f = frames(spark, sf, "frame_index").filter("index % 2 = 0").select("index", (F.col("frame_index") * 10.0).alias("value"))
    dataset.update_columns(spark, root, f, {"value": -1.0})
    return dataset.scan_frames(spark, root).select("index", "value", "frame_index")


@query(with_(EP) + "select 30 as fps, count(*) as total_episodes, sum(length)::bigint as total_frames, (select count(*) from tasks) as total_tasks, '0:' || count(*) as train from eps")
def sink_meta_json(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the dataset through info.json."""
    e, t = episodes(spark, sf), tasks(spark, sf)
    root, n = Workspace(spark, "meta").path("root"), e.agg(F.count(F.lit(1)).alias("e"), F.sum("length").alias("f")).first()
    dataset.write_meta(spark, root, {"fps": 30, "features": {}, "total_episodes": n["e"], "total_frames": n["f"], "total_tasks": t.count(), "splits": {"train": f"0:{n['e']}"}}, t, e.select("episode_index", "tasks", "length"))
    i = dataset.scan_info(spark, root)
    return spark.createDataFrame([(i["fps"], i["total_episodes"], i["total_frames"], i["total_tasks"], i["splits"]["train"])], "fps int, total_episodes bigint, total_frames bigint, total_tasks bigint, train string")


@query("select vec_id, 64 as n from embeddings")
def sink_parquet_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images as struct of bytes and path under a declared schema."""
    schema = dataset.frame_schema({"vec_id": {"dtype": "int64", "shape": (1,)}, "image": {"dtype": "image", "shape": (8, 8, 1)}})
    e = table(spark, sf, "embeddings").select("vec_id", F.struct(F.lpad(F.lit("x"), 64, "x").cast("binary").alias("bytes"), F.lit("a.png").alias("path")).alias("image"))
    path = Workspace(spark, "images").path("out")
    e.write.parquet(path)
    return spark.read.schema(schema).parquet(path).select("vec_id", F.octet_length("image.bytes").alias("n"))


_TR = "b as (select i, ep, fi, coalesce(iv, 0) > 0.5 as dn from fr), c as (select *, coalesce(sum(dn::integer) over (partition by ep order by i rows between unbounded preceding and 1 preceding), 0) as e from b)"


@query(with_(FR, _TR) + "select i as \"index\", e::bigint as episode_no, row_number() over (partition by ep, e order by i) - 1 as frame_no from c")
def sink_transition_table(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "intervention").select(F.col("index").alias("seq"), F.col("episode_index").alias("stream"), (F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5).alias("done"), F.lit(False).alias("truncated"))
    return windows.transitions_to_episodes(f).select(F.col("seq").alias("index"), F.col("episode_no").cast("bigint").alias("episode_no"), F.col("frame_no").cast("bigint").alias("frame_no"))


@query(with_(FR) + "select ep as episode_index, arg_min(i, fi * 1000000000 + i) as first_index, arg_max(i, fi * 1000000000 + i) as last_index from fr group by ep")
def sink_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = Workspace(spark, "manifest").path("csv")
    dataset.write_manifest(windows.boundary_rows(frames(spark, sf, "frame_index")), path)
    return spark.read.option("header", True).schema("episode_index long, first_index long, last_index long").csv(path)


@query(with_(FR, EP, "g as (select min(length)::double as lo, max(length)::double as hi from eps)", "b as (select case when hi > lo then least(19, floor((length - lo) / ((hi - lo) / 20))) else 0 end as bin, count(*) as n from eps, g group by 1)") + """
select 'episodes' as name, count(*) as n from eps union all select 'success', count(case when label = 'success' then 1 end) from eps union all select 'failure', count(case when label = 'failure' then 1 end) from eps
union all select 'unlabeled', count(case when label is null or label not in ('success', 'failure') then 1 end) from eps union all select 'tasks', count(distinct tasks[1]) from eps union all select 'frames', count(*) from fr
union all select 'intervention_frames', count(case when iv > 0 then 1 end) from fr union all select 'intervention_episodes', count(distinct case when iv > 0 then ep end) from fr
union all select 'bar ' || k, coalesce(n, 0) from (select unnest(range(0, 20)) as k) x left join b on b.bin = x.k""")
def sink_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every count in the text report, its bars included."""
    e = episodes(spark, sf)
    lines = metrics.text_report(metrics.dataset_report(frames(spark, sf, "intervention"), e), e).splitlines()
    told = [x.partition(": ") for x in lines if not x.startswith("[")]
    rows = [(k, int(v)) for k, _, v in told if v.isdigit()]
    rows += [(f"bar {i}", int(x.split(")")[1].split()[0])) for i, x in enumerate(x for x in lines if x.startswith("["))]
    return spark.createDataFrame(rows, "name string, n bigint")


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    """All frames recorded in three batches, every episode in at least two of them if it has two frames, the second batch sent again; then saved."""
    from pyspark.sql.window import Window

    ws = Workspace(spark, "recording")
    w = Window.partitionBy("episode_index")
    part = F.floor((F.row_number().over(w.orderBy("index")) - 1) * 3 / F.count(F.lit(1)).over(w))
    f = frames(spark, sf, "task_index", "action").withColumn("part", part)
    f = f.join(F.broadcast(tasks(spark, sf)), ["task_index"], "left").drop("task_index")
    src = ws.save(f.withColumnsRenamed({"index": "seq"}).withColumn("recorded", F.col("episode_index")), "src")
    rec = dataset.Recorder(ws.path("out"), 30.0)
    for number in (0, 1, 1, 2):
        rec.write_batch(src.filter(F.col("part") == number).drop("part"), number)
    rec.save(spark, {"action": FEATURES["action"]}, tasks(spark, sf))
    return dataset.scan_frames(spark, rec.root).withColumn("timestamp", r(F.col("timestamp").cast("double"), 4))


@query(with_(FR) + "select i as seq, dense_rank() over (order by ep) - 1 as episode_index, row_number() over (order by ep, i) - 1 as \"index\", row_number() over (partition by ep order by i) - 1 as frame_index, round(((row_number() over (partition by ep order by i) - 1) / 30.0)::float::double, 4) as timestamp, t.task_index from fr left join tasks t on t.task_index = fr.task")
def sink_recording(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame as recorded and saved, with its ids."""
    return _recorded(spark, sf).select("seq", "episode_index", "index", "frame_index", "timestamp", "task_index")


@query(with_(FR, EP) + "select (select count(*) from fr) as frames, (select count(*) from eps) as total_episodes, (select sum(length)::bigint from eps) as total_frames")
def cli_convert(spark: SparkSession, sf: str) -> DataFrame:
    """One file an episode and JSON lines to the layout of sized files."""
    ws = Workspace(spark, "convert")
    old, new = ws.path("old"), ws.path("new")
    f, e = frames(spark, sf, "frame_index", "timestamp", "task_index"), episodes(spark, sf)
    f.withColumn("chunk", F.floor(F.col("episode_index") / 1000)).write.partitionBy("chunk").parquet(f"{old}/data")
    e.select("episode_index", "tasks", "length").write.json(f"{old}/meta/episodes.jsonl")
    tasks(spark, sf).write.json(f"{old}/meta/tasks.jsonl")
    dataset.write_text(spark, f"{old}/meta/info.json", json.dumps({"fps": 30, "features": {}}))
    dataset.convert_per_episode_layout(spark, old, new)
    info = dataset.scan_info(spark, new)
    return dataset.scan_frames(spark, new).agg(F.count(F.lit(1)).alias("frames")).select("frames", F.lit(info["total_episodes"]).cast("bigint").alias("total_episodes"), F.lit(info["total_frames"]).cast("bigint").alias("total_frames"))


@query("select * from (values ('action', 2), ('observation.images.top', 3), ('observation.state', 3)) t(feature, n)")
def project_hw_features(spark: SparkSession, sf: str) -> DataFrame:
    a = dataset.hardware_features({"pan": float, "lift": float}, "action")
    b = dataset.merge_features(dataset.hardware_features({"pan": float, "top": (48, 64, 3)}, "observation"), dataset.hardware_features({"lift": float, "pan": float, "grip": float}, "observation"))
    return spark.createDataFrame([(k, len(v["names"])) for k, v in {**a, **b}.items()], "feature string, n int")


@query(with_(FR) + "select count(*)::bigint as wrong from fr where len(action) <> 6 or action is null having count(*) > 0")
def scan_wrong_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.wrong_shapes(frames(spark, sf, "action"), {"action": {"dtype": "float32", "shape": (6,)}}).select(F.col("rows").alias("wrong"))


@query("select task_index, (['png', 'gif', 'jpeg', 'bmp'])[task_index % 4 + 1] as format, (100 + task_index)::integer as width, (50 + 2 * task_index)::integer as height from tasks")
def scan_media_info(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of four formats, one image a task."""
    path = Workspace(spark, "media").path("in")
    big, small = (lambda n, k: int(n).to_bytes(k, "big")), (lambda n, k: int(n).to_bytes(k, "little"))
    for x in tasks(spark, sf).select("task_index").collect():
        t = x["task_index"]
        w, h = 100 + t, 50 + 2 * t
        content = (
            b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + big(w, 4) + big(h, 4), b"GIF89a" + small(w, 2) + small(h, 2),
            b"\xff\xd8\xff\xe0" + big(16, 2) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc2" + big(11, 2) + b"\x08" + big(h, 2) + big(w, 2) + b"\x01" * 5, b"BM" + b"\0" * 12 + small(40, 4) + small(w, 4) + small(h, 4),
        )[t % 4]
        _put(spark, f"{path}/{t}.img", content)
    return dataset.media_info(dataset.scan_images(spark, path)).select(F.regexp_extract("path", r"(\d+)\.img$", 1).cast("bigint").alias("task_index"), "format", "width", "height")


@query(with_(EP, "c as (select ep, length, sum(length) over (order by ep)::bigint as upto from eps)", "v as (select *, cast(floor((upto - 1) / 30.0 / 60.0) as integer) as f from c)") + "select ep as episode_index, f as video_file, round((upto - length - min(upto - length) over (partition by f)) / 30.0, 5) as from_timestamp, round((upto - min(upto - length) over (partition by f)) / 30.0, 5) as to_timestamp from v")
def sink_video(spark: SparkSession, sf: str) -> DataFrame:
    """Where each episode lies in its video file; encoding needs a codec."""
    v = dataset.video_places(episodes(spark, sf), 30.0, 60.0)
    return v.select("episode_index", "video_file", r("from_timestamp").alias("from_timestamp"), r("to_timestamp").alias("to_timestamp"))
