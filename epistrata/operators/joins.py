"""Joins of frames with dimensions, intervals and neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.functions import text
from epistrata.operators.carry import known_around
from epistrata.runtime import c, hot_join, lookup_join


def with_tasks(frames: DataFrame, tasks: DataFrame, subtasks: DataFrame | None = None) -> DataFrame:
    """Frames with their task's text (and subtask's, by subtask_index); null where unknown."""
    out = lookup_join(frames, tasks.select("task_index", "task"), ["task_index"], "left")
    return lookup_join(out, subtasks.select("subtask_index", "subtask"), ["subtask_index"], "left") if subtasks is not None else out


def positional(tasks: DataFrame) -> DataFrame:
    """Rows whose task_index is not their position in order of task_index: where a lookup by position would differ from one by key."""
    ranked = tasks.select("task_index", (F.row_number().over(Window.orderBy("task_index")) - 1).alias("position"))  # the catalogue of tasks
    return ranked.filter("task_index <> position")


def with_episodes(frames: DataFrame, episodes: DataFrame, columns: list[str], required: bool = True) -> DataFrame:
    """Frames with columns of their episode; a frame without an episode raises if required."""
    found = episodes.select("episode_index", *[c(k) for k in columns], F.lit(True).alias("__found"))
    out = hot_join(frames, found, ["episode_index"], "left")
    if required:
        ok = F.assert_true(F.col("__found").isNotNull(), F.concat(F.lit("no episode "), F.coalesce(F.col("episode_index").cast("string"), F.lit("null"))))
        out = out.filter(ok.isNull())
    return out.drop("__found")


def file_destinations(episodes: DataFrame, files: DataFrame, current: tuple[int, int]) -> DataFrame:
    """Episodes with chunk and file of where their file went; those of files not in the map are at the current destination."""
    out = lookup_join(episodes, files.select("chunk_index", "file_index", "dst_chunk", "dst_file"), ["chunk_index", "file_index"], "left")
    return out.withColumn("dst_chunk", F.coalesce("dst_chunk", F.lit(current[0]))).withColumn("dst_file", F.coalesce("dst_file", F.lit(current[1])))


def nearest_in_time(queries: DataFrame, frames: DataFrame, tolerance: float, cell_s: float = 60.0) -> DataFrame:
    """(query_id, index, dt, is_pad): the frame of the episode nearest to each query time; farther than the tolerance it is padding.

    The last frame at or before the query and the first one after, by windows over cells of ``cell_s`` seconds and edges carried from cell to cell. On a tie the earlier frame. Queries of episodes without
    frames have index null and are padding.
    """
    q = queries.select("episode_index", F.col("ts").cast("double").alias("ts"), F.lit(1).alias("k"), "query_id", F.lit(None).cast("struct<t:double,i:bigint>").alias("f"))
    f = frames.select("episode_index", F.col("timestamp").cast("double").alias("ts"), F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("query_id"), F.struct(F.col("timestamp").cast("double").alias("t"), F.col("index").alias("i")).alias("f")).filter("ts is not null")
    both = q.unionByName(f)
    place = [F.col("ts"), F.col("k"), F.col("query_id")]
    near = known_around(both, ["episode_index"], F.floor(F.col("ts") / cell_s), [*place, -F.col("f.i")], F.col("f"), "a", "b", [*place, F.col("f.i")]).filter("k = 1")
    da, db = F.col("ts") - F.col("a.t"), F.col("b.t") - F.col("ts")
    take_b = F.col("a").isNull() | (db < da)
    dt = F.when(take_b, db).otherwise(da)
    return near.select("query_id", F.when(take_b, F.col("b.i")).otherwise(F.col("a.i")).alias("index"), dt.alias("dt"), F.coalesce(dt > tolerance, F.lit(True)).alias("is_pad"))


def within_time(frames: DataFrame, samples: DataFrame, tolerance: float) -> DataFrame:
    """(index, sensor_key, sample_id): for each frame and sensor the largest id of the samples of its episode at most ``tolerance`` seconds away.

    An equi-join by episode and cell of four tolerances, so a frame meets the samples about it and not all of its episode.
    """
    width = 4 * tolerance
    cell = lambda t: F.floor(t / width)
    f = frames.filter("timestamp is not null").select("index", "episode_index", F.col("timestamp").alias("__t"), cell(F.col("timestamp")).alias("__c"))
    s = samples.filter("timestamp is not null").select("episode_index", "sensor_key", "sample_id", F.col("timestamp").alias("__s"))
    s = s.withColumn("__c", F.explode(F.array_distinct(F.array(cell(F.col("__s") - tolerance), cell(F.col("__s") + tolerance)))))
    return f.join(s, ["episode_index", "__c"]).filter(F.abs(F.col("__s") - F.col("__t")) <= tolerance).groupBy("index", "sensor_key").agg(F.max("sample_id").alias("sample_id"))


def out_of_tolerance(matches: DataFrame, queries: DataFrame, frames: DataFrame) -> DataFrame:
    """Queries inside their episode's time span whose nearest frame is too far: an error in the data, not padding."""
    span = frames.groupBy("episode_index").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return matches.filter("is_pad").join(queries, ["query_id"]).join(span, ["episode_index"]).filter("ts between lo and hi").select("query_id", "episode_index", "ts", "dt")


def in_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames with each segment of their episode whose [start, end] holds their timestamp, both ends included; overlaps repeat frames."""
    s = segments.select("episode_index", "segment", "start", "end")
    return hot_join(frames, s, ["episode_index"]).filter((F.col("timestamp") >= F.col("start")) & (F.col("timestamp") <= F.col("end")))


def episode_of_index(rows: DataFrame, episodes: DataFrame, key: str = "index", width: int = 1 << 16) -> DataFrame:
    """Rows with the episode whose [from, to) holds their index, 0 where none does. An equi-join by stretches of the index, so no row meets all episodes."""
    e = episodes.select(F.col("episode_index").alias("__e"), F.col("dataset_from_index").alias("__a"), F.col("dataset_to_index").alias("__b")).filter("__b > __a")
    e = e.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor((F.col("__b") - 1) / width))))
    ids = rows.select(c(key).alias("__k")).filter("__k is not null").distinct().withColumn("__cell", F.floor(F.col("__k") / width))
    hit = ids.join(e, ["__cell"]).filter((F.col("__k") >= F.col("__a")) & (F.col("__k") < F.col("__b"))).groupBy("__k").agg(F.min("__e").alias("__e"))
    return rows.join(hit, rows[key] == hit["__k"], "left").drop("__k").withColumn("episode", F.coalesce("__e", F.lit(0))).drop("__e")


def clip_ranges(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes with first and last timestamp and number of their frames; those without frames are left out."""
    span = frames.filter("timestamp is not null").groupBy("episode_index").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("frames"))
    return episodes.select("episode_index", "length").join(span, ["episode_index"])


def with_predictions(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """Frames with the last prediction (by ``seq``) for their index, null where there is none."""
    last = predictions.groupBy("index").agg(F.max_by("value", "seq").alias("value"))
    return frames.join(last, ["index"], "left")


def with_progress(frames: DataFrame, progress: DataFrame) -> DataFrame:
    """Frames that have a progress which is not NaN, with the bounds of their episode's known indices."""
    p = progress.filter("progress is not null and not isnan(progress)").groupBy("index").agg(F.max("progress").alias("progress"))
    near = frames.select("index", "episode_index").join(p, ["index"])
    w = Window.partitionBy("episode_index")
    return near.select("index", "episode_index", "progress", F.min("index").over(w).alias("start"), (F.max("index").over(w) + 1).alias("end"))


def annotated_segments(annotations: DataFrame, bounds: DataFrame, pre: float, post: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(segments, failures) of JSON annotations {segments: [{name, start, end, confidence}]} per episode.

    Segments get margins and are clamped to the episode's times. Failures have a reason: missing annotation, low confidence, empty segment.
    """
    schema = "struct<segments:array<struct<name:string,start:string,end:string,confidence:double>>>"
    parsed = F.from_json(text.repaired_json(F.col("annotation")), schema)["segments"]
    rows = bounds.join(annotations.select("episode_index", "annotation"), ["episode_index"], "left").select("episode_index", "start_s", "end_s", F.explode_outer(parsed).alias("g"))
    a, b = text.seconds_of(F.col("g.start")).cast("double"), text.seconds_of(F.col("g.end")).cast("double")
    reason = F.when(F.col("g").isNull(), "missing annotation").when(F.coalesce(F.col("g.confidence"), F.lit(0.0)) < least, "low confidence").when(a.isNull() | b.isNull() | (b <= a), "empty segment")
    out = rows.select("episode_index", F.col("g.name").alias("segment"), F.greatest(F.col("start_s"), a - pre).alias("start"), F.least(F.col("end_s"), b + post).alias("end"), reason.alias("reason"))
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null").select("episode_index", "segment", "reason")


def flatten_groups(df: DataFrame, nested: str) -> DataFrame:
    """Rows (group, task, value) of a map of maps."""
    return df.select(F.explode(c(nested)).alias("group", "__m")).select("group", F.explode("__m").alias("task", "value"))


def frames_of_kept(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames of the episodes given."""
    return hot_join(frames, episodes.select("episode_index").distinct(), ["episode_index"], "left_semi")


def stage_arrays(segments: DataFrame, names: list[str]) -> DataFrame:
    """(episode_index, stages): the episode's segments as array of struct(stage, start, end) in order of start; unknown names are stage 0."""
    stage: Column = F.lit(0)
    for k, n in enumerate(names):
        stage = F.when(F.col("segment") == n, k).otherwise(stage)
    s = segments.select("episode_index", F.struct(F.col("start").alias("start"), F.col("end").alias("end"), stage.cast("int").alias("stage")).alias("s"))
    return s.groupBy("episode_index").agg(F.sort_array(F.collect_list("s")).alias("stages"))  # the segments of one episode
