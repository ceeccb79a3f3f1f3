"""Reading and writing the on-disk layout of a dataset: data/chunk-XXX/file-XXX.parquet, meta/episodes, meta/tasks.parquet, meta/info.json, meta/stats.json."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epistrata.runtime import Workspace, c, delete_path, lookup_join

#: Fixed values of the layout.
MAX_DATA_MB = 100
FILES_PER_CHUNK = 1000
DATA_PATH = "data/chunk-{chunk:03d}/file-{file:03d}.parquet"
SCALARS = {"float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(), "uint8": T.ShortType(), "bool": T.BooleanType(), "string": T.StringType()}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename onto it."""
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """A folder of files that stay as they are, through Hadoop's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    b.mkdirs(q.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, conf)


# --- schema ---


def feature_type(spec: dict[str, Any]) -> T.DataType | None:
    """Column type of a feature: scalars for shape (1,), nested arrays for vectors up to five dimensions, a struct for images, none for videos."""
    if spec["dtype"] == "video":
        return None
    if spec["dtype"] == "image":
        return T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
    shape = tuple(spec.get("shape") or (1,))
    kind: T.DataType = SCALARS[spec["dtype"]]
    if shape == (1,):
        return kind
    if len(shape) > 5:
        raise ValueError(f"too many dimensions: {shape}")
    for _ in shape:
        kind = T.ArrayType(kind)
    return kind


def frame_schema(features: dict[str, dict[str, Any]]) -> T.StructType:
    """Schema of the frame table; a slash in a feature's name is an error."""
    if bad := [n for n in features if "/" in n]:
        raise ValueError(f"no slash in feature names: {bad}")
    return T.StructType([T.StructField(n, t) for n, s in features.items() if (t := feature_type(s)) is not None])


def hardware_features(spec: dict[str, Any], prefix: str, use_video: bool = True) -> dict[str, dict[str, Any]]:
    """Features of a device: rows (feature, part, shape) of its parts, grouped. Numbers form one vector with their names, a camera is an image by itself."""
    vector = prefix if prefix == "action" else f"{prefix}.state"
    rows = [(vector, n, None) if t is float else (f"{prefix}.images.{n}", None, tuple(t)) for n, t in spec.items() if t is float or isinstance(t, tuple)]
    parts: dict[str, list[str]] = {}
    for feature, part, _ in rows:
        parts.setdefault(feature, []).extend([part] if part else [])
    shapes = {feature: shape for feature, _, shape in rows if shape}
    numbers = {f: {"dtype": "float32", "shape": (len(names),), "names": names} for f, names in parts.items() if f not in shapes}
    pictures = {f: {"dtype": "video" if use_video else "image", "shape": s, "names": ["height", "width", "channels"]} for f, s in shapes.items()}
    return numbers | pictures


def merge_features(*parts: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Union of feature dicts; the names of a vector in both are joined in order, differing types are an error."""
    out: dict[str, dict[str, Any]] = {}
    for part in parts:
        for n, s in part.items():
            have = out.get(n)
            if have is None:
                out[n] = dict(s)
                continue
            if have["dtype"] != s["dtype"]:
                raise ValueError(f"{n} is {have['dtype']} and {s['dtype']}")
            joined = list(dict.fromkeys([*(have.get("names") or []), *(s.get("names") or [])]))
            out[n] = {**have, "names": joined, "shape": (len(joined),) if joined else have["shape"]}
    return out


def wrong_shapes(df: DataFrame, features: dict[str, dict[str, Any]]) -> DataFrame:
    """(feature, rows): vectors of another length than declared."""
    bad = [F.count_if(F.size(c(n)) != s["shape"][0]).alias(n) for n, s in features.items() if len(s.get("shape", ())) == 1 and tuple(s["shape"]) != (1,) and n in df.columns]
    if not bad:
        return df.sparkSession.createDataFrame([], "feature string, rows long")
    one = df.agg(*bad)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in one.columns]), F.array(*[c(n) for n in one.columns]))).alias("feature", "rows")).filter("rows > 0")


# --- scans ---


def scan_frames(spark: SparkSession, root: str, features: dict[str, dict[str, Any]] | None = None, episodes: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Frames of all data files; episodes become a pushed-down filter, columns prune the scan."""
    reader = spark.read.schema(frame_schema(features)) if features else spark.read
    df = reader.option("recursiveFileLookup", True).parquet(f"{root}/data")
    if columns:
        df = df.select(*[c(n) for n in columns])
    return df.filter(F.col("episode_index").isin([int(e) for e in episodes])) if episodes is not None else df


def missing_videos(spark: SparkSession, root: str, videos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(episode_index, path): video files that episodes (episode_index, chunk_index, file_index) name and the dataset lacks; only paths are listed, no content is read."""
    want = videos.select("episode_index", F.explode(F.array(*[F.format_string(f"videos/{k}/chunk-%03d/file-%03d.mp4", F.col("chunk_index").cast("int"), F.col("file_index").cast("int")) for k in keys])).alias("path"))
    if not exists(spark, f"{root}/videos"):
        return want
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/videos").select(F.regexp_extract("path", r"(videos/.*)$", 1).alias("path"))
    return want.join(have.distinct(), ["path"], "left_anti").select("episode_index", "path")


def scan_frames_checked(spark: SparkSession, root: str, episodes: Sequence[int], videos: DataFrame | None = None, video_keys: Sequence[str] = (), **more: Any) -> DataFrame:
    """scan_frames, once all episodes asked for are known to be there, and the video files they name too."""
    df = scan_frames(spark, root, episodes=episodes, **more)
    asked = spark.createDataFrame([(int(e),) for e in episodes], "episode_index long")
    lost = [r[0] for r in asked.join(df.select("episode_index").distinct(), ["episode_index"], "left_anti").limit(20).collect()]
    if lost:
        raise ValueError(f"episodes without frames: {sorted(lost)}")
    if videos is not None and video_keys:
        gone = missing_videos(spark, root, videos.join(asked, ["episode_index"], "left_semi"), video_keys).limit(20).collect()
        if gone:
            raise ValueError(f"missing videos: {sorted(r['path'] for r in gone)}")
    return df


def scan_episodes(spark: SparkSession, root: str, stats: bool = False, episode: int | None = None) -> DataFrame:
    """Episode rows without their stats columns unless asked for; of one episode if asked."""
    df = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    if not stats:
        df = df.select(*[c(n) for n in df.columns if not n.startswith("stats/")])
    return df if episode is None else df.filter(F.col("episode_index") == episode)


def scan_tasks(spark: SparkSession, root: str, name: str = "tasks") -> DataFrame | None:
    """(task, task_index) whatever the text column is called; None if there is no such table (subtasks)."""
    if not exists(spark, f"{root}/meta/{name}.parquet"):
        return None
    df = spark.read.parquet(f"{root}/meta/{name}.parquet")
    key = "subtask_index" if "subtask_index" in df.columns else "task_index"
    label = next(n for n in df.columns if n != key)
    return df.select(c(label).alias(key.removesuffix("_index")), c(key))


def scan_info(spark: SparkSession, root: str) -> dict[str, Any]:
    info = json.loads(read_text(spark, f"{root}/meta/info.json"))
    for s in info.get("features", {}).values():
        s["shape"] = tuple(s["shape"])
    return info


def flatten(d: dict[str, Any], sep: str = "/", prefix: str = "") -> dict[str, Any]:
    """Nested dict to keys a/b/c."""
    out: dict[str, Any] = {}
    for k, v in d.items():
        if isinstance(v, dict):
            out |= flatten(v, sep, f"{prefix}{k}{sep}")
        else:
            out[prefix + k] = v
    return out


def unflatten(d: dict[str, Any], sep: str = "/") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in d.items():
        *path, last = k.split(sep)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def scan_stats(spark: SparkSession, root: str) -> DataFrame:
    """(feature, stat, dim, value) of the statistics file."""
    rows = []
    for k, v in flatten(json.loads(read_text(spark, f"{root}/meta/stats.json"))).items():
        feature, _, stat = k.rpartition("/")
        rows += [(feature, stat, i, float(x)) for i, x in enumerate(v if isinstance(v, list) else [v]) if not isinstance(x, list)]
    return spark.createDataFrame(rows, "feature string, stat string, dim int, value double")


def scan_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes) from the files' metadata; no data column is read."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("b")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("b").alias("bytes"))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_images(spark: SparkSession, path: str, rows: Sequence[int] | None = None) -> DataFrame:
    """(path, content) of image files, of some by position in path order if asked. Positions come from range partitions of the paths and their sizes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    if rows is None:
        return df
    parts = Workspace(spark, "paths").save(df.select("path").repartitionByRange("path").withColumn("p", F.spark_partition_id()), "parts")
    before = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))  # one row a partition
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("path")) - 1).join(F.broadcast(before), ["p"])
    asked = spark.createDataFrame([(int(k),) for k in rows], "k long")
    return df.join(ranked.select("path", (F.col("n0") + F.col("r")).alias("k")).join(asked, ["k"], "left_semi"), ["path"], "left_semi")


def image_header(b: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height from the first bytes of a PNG, GIF, BMP or JPEG; nulls for others."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return "png", int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:4] == b"GIF8" and len(b) >= 10:
        return "gif", int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:2] == b"BM" and len(b) >= 26:
        return "bmp", int.from_bytes(b[18:22], "little", signed=True), abs(int.from_bytes(b[22:26], "little", signed=True))
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a start of frame
            return "jpeg", int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None, None, None


def media_info(images: DataFrame) -> DataFrame:
    """(path, format, width, height) from the headers of PNG, GIF, BMP and JPEG images; nulls for others, which need a codec. 64 KB of each file go to Python."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            told = [image_header(x or b"") for x in b.column(1).to_pylist()]
            cols = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["path", "format", "width", "height"])

    return images.select("path", F.substring("content", 1, 65536).alias("head")).mapInArrow(run, "path string, format string, width int, height int")


def stream_frames(spark: SparkSession, root: str, features: dict[str, dict[str, Any]], files_per_batch: int = 16) -> DataFrame:
    """The data files as a stream."""
    return spark.readStream.schema(frame_schema(features)).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/data")


def nested_episodes_to_frames(df: DataFrame, steps: str, vectors: dict[str, Sequence[str]], constants: Sequence[str], scalars: Sequence[str] = ()) -> DataFrame:
    """One row an episode with an array of steps to one row a frame: fields joined to float vectors, constants repeated, scalars of a step as they are."""
    flat = df.select(F.col("episode_index"), *[c(k) for k in constants], F.posexplode(c(steps)).alias("frame_index", "s"))
    joined = [F.concat(*[F.col(f"s.{p}") for p in parts]).cast("array<float>").alias(name) for name, parts in vectors.items()]
    own = [F.col("s").getField(k).alias(k) for k in scalars]
    return flat.select("episode_index", F.col("frame_index").cast("long").alias("frame_index"), *joined, *own, *[c(k) for k in constants])


# --- sinks ---


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Episodes with dataset_from_index and dataset_to_index as running sums of their lengths."""
    from epistrata.operators.episodes import dense_episodes

    keys = dense_episodes(episodes.select("episode_index", "length")).select("episode_index", F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"))
    return episodes.drop("dataset_from_index", "dataset_to_index").join(keys, ["episode_index"])


def write_frames(df: DataFrame, root: str, rows_per_file: int = 1_000_000) -> None:
    """Frames sorted by episode and frame in files of bounded size, so that episode filters skip row groups."""
    df.repartitionByRange("episode_index", "frame_index").sortWithinPartitions("episode_index", "frame_index").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/data")


def update_columns(spark: SparkSession, root: str, values: DataFrame, defaults: dict[str, Any]) -> None:
    """Add or overwrite columns by ``index``: rows without a new value keep the old one, or get the default if the column is new.

    Written beside the data and swapped in by renames; the old folder goes last.
    """
    old = scan_frames(spark, root)
    names = list(defaults)
    new = values.select("index", *[c(n).alias(f"__new_{n}") for n in names])
    both = old.join(new, ["index"], "left")
    kept = [c(n) for n in old.columns if n not in names]
    out = [F.coalesce(c(f"__new_{n}"), c(n) if n in old.columns else F.lit(defaults[n])).alias(n) for n in names]
    tmp = f"{root}/data.new"
    both.select(*kept, *out).sortWithinPartitions("episode_index", "frame_index").write.mode("overwrite").parquet(tmp)
    if spark.read.parquet(tmp).count() != old.count():
        raise RuntimeError("rows were lost or doubled; the data stays as it was")
    fs, data = _fs(spark, f"{root}/data")
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    delete_path(spark, f"{root}/data.old")
    fs.rename(data, P(f"{root}/data.old"))
    fs.rename(P(tmp), data)
    delete_path(spark, f"{root}/data.old")
    spark.catalog.refreshByPath(f"{root}/data")


def write_meta(spark: SparkSession, root: str, info: dict[str, Any], tasks: DataFrame, episodes: DataFrame, stats: dict[str, Any] | None = None, most_episodes: int | None = None) -> None:
    """info.json, tasks, episodes and stats.json; more episodes than the limit are refused."""
    if most_episodes is not None and episodes.limit(most_episodes + 1).count() > most_episodes:
        raise ValueError(f"more than {most_episodes} episodes")
    tasks.coalesce(1).write.mode("overwrite").parquet(f"{root}/meta/tasks.parquet")
    episodes.write.mode("overwrite").parquet(f"{root}/meta/episodes")
    write_text(spark, f"{root}/meta/info.json", json.dumps(info, indent=2))
    if stats is not None:
        write_text(spark, f"{root}/meta/stats.json", json.dumps(stats, indent=2))


def write_manifest(rows: DataFrame, path: str) -> None:
    """First and last frames of episodes as CSV."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def video_places(episodes: DataFrame, fps: float, most_s: float, key: str = "episode_index") -> DataFrame:
    """(episode_index, video_file, from_timestamp, to_timestamp): where episodes lie in videos of at most about ``most_s`` seconds.

    A video takes the episodes that end in its stretch of the total time, so places come from running sums and no greedy fold over all episodes; the media
    themselves are for a codec.
    """
    from epistrata.operators.episodes import dense_episodes

    keys = dense_episodes(episodes.select(F.col(key).alias("episode_index"), "length"))
    placed = keys.withColumn("video_file", F.floor((F.col("to_index") - 1) / fps / most_s).cast("int"))
    w = Window.partitionBy("video_file")  # the episodes of one file
    start = F.min("from_index").over(w)
    return placed.select("episode_index", "video_file", ((F.col("from_index") - start) / fps).alias("from_timestamp"), ((F.col("to_index") - start) / fps).alias("to_timestamp"))


class Recorder:
    """Appends a stream of recorded frames and saves them as a dataset.

    ``write_batch`` is a foreachBatch function: a batch goes to a folder of its number, so a retry replaces it. frame_index counts up in an episode over
    all batches with a smaller number, timestamp is frame_index / fps where absent. ``save`` gives index, episode and task ids and statistics.
    """

    def __init__(self, root: str, fps: float):
        self.root, self.fps = root, fps
        self.frames, self.lengths = f"{root}/recording/frames", f"{root}/recording/lengths"

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """Rows of a batch: episode_index, seq (their order), and what else was recorded. Frames an episode has from earlier batches come from small tables of lengths."""
        spark = batch.sparkSession
        w = Window.partitionBy("episode_index").orderBy("seq")
        out = batch.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
        if exists(spark, self.lengths):
            before = spark.read.schema("episode_index long, length long, batch_id long").parquet(self.lengths).filter(F.col("batch_id") < number)
            before = before.groupBy("episode_index").agg(F.sum("length").alias("__before"))
            out = out.join(before, ["episode_index"], "left").withColumn("frame_index", F.col("frame_index") + F.coalesce("__before", F.lit(0))).drop("__before")
        told = F.col("timestamp").cast("double") if "timestamp" in batch.columns else F.lit(None).cast("double")
        out = out.withColumn("timestamp", F.coalesce(told, F.col("frame_index") / self.fps).cast("float"))
        path = f"{self.frames}/batch_id={number}"
        out.write.mode("overwrite").parquet(path)
        written = spark.read.schema(out.schema).parquet(path)
        written.groupBy(F.col("episode_index").cast("long").alias("episode_index")).agg(F.count(F.lit(1)).alias("length")).write.mode("overwrite").parquet(f"{self.lengths}/batch_id={number}")

    def save(self, spark: SparkSession, features: dict[str, dict[str, Any]], known_tasks: DataFrame | None = None) -> None:
        """All that was recorded as data and meta; made anew from the recording, so it may be called again after more batches.

        Episodes get dense ids in the order of the recorded ones and index runs through them. Texts of column ``task`` keep the ids of an earlier save, or
        of ``known_tasks`` before the first; new ones follow. Statistics of ``features`` are those of each episode, and their merge.
        """
        from epistrata.operators.episodes import dense_episodes, upsert_tasks
        from epistrata.operators.stats import NAMES, feature_stats, merge_stats
        ws = Workspace(spark, "recorder")
        f = spark.read.parquet(self.frames).drop("batch_id")
        if "task" not in f.columns:
            f = f.withColumn("task", F.lit(None).cast("string"))
        earlier = scan_tasks(spark, self.root)
        earlier = earlier if earlier is not None else known_tasks if known_tasks is not None else spark.createDataFrame([], "task string, task_index long")
        tasks = ws.save(upsert_tasks(earlier, f), "tasks")
        lengths = spark.read.schema("episode_index long, length long, batch_id long").parquet(self.lengths).groupBy("episode_index").agg(F.sum("length").alias("length"))
        keys = ws.save(dense_episodes(lengths), "keys")
        ids = tasks.groupBy("task").agg(F.min("task_index").alias("task_index"))
        f = f.join(keys.select("episode_index", "new_index", "from_index"), ["episode_index"])
        f = lookup_join(f, ids, ["task"], "left").withColumn("index", F.col("from_index") + F.col("frame_index")).withColumn("episode_index", F.col("new_index")).drop("new_index", "from_index")
        f = ws.save(f, "frames")
        write_frames(f.drop("task"), self.root)
        every = ("min", "max", "mean", "std", "count", *NAMES)
        parts = ws.save(feature_stats(f, list(features), ["episode_index"]), "stats")
        episodes = keys.select(F.col("new_index").alias("episode_index"), "length", F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"))
        episodes = episodes.join(f.groupBy("episode_index").agg(F.sort_array(F.collect_set("task")).alias("tasks")), ["episode_index"])
        for n in features:
            of = parts.filter(F.col("feature") == n).groupBy("episode_index").agg(F.max("dim").alias("__d"), F.map_from_entries(F.collect_list(F.struct("dim", F.struct(*every)))).alias("__m"))
            of = of.select("episode_index", *[F.transform(F.sequence(F.lit(0), F.col("__d")), lambda d: F.try_element_at(F.col("__m"), d)[k]).alias(f"stats/{n}/{k}") for k in every])
            episodes = episodes.join(of, ["episode_index"], "left")
        whole: dict[str, Any] = {}
        for r in merge_stats(parts).orderBy("feature", "dim").collect():
            for k in every:
                at = whole.setdefault(r["feature"], {}).setdefault(k, [])
                at += [None] * (r["dim"] - len(at)) + [r[k]]
        n = lengths.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("length"), F.lit(0)).alias("f")).first()
        info = {"fps": self.fps, "features": {k: {**v, "shape": list(v.get("shape") or (1,))} for k, v in features.items()}, "total_episodes": n["e"], "total_frames": n["f"], "total_tasks": tasks.count(), "splits": {"train": f"0:{n['e']}"}}
        write_meta(spark, self.root, info, tasks, episodes, whole)
        ws.drop(f, parts)


def convert_per_episode_layout(spark: SparkSession, old: str, new: str, episodes_schema: str = "episode_index long, tasks array<string>, length long", tasks_schema: str = "task_index long, task string") -> None:
    """A dataset of one Parquet file an episode and JSON-lines metadata to the layout of sized files."""
    frames = spark.read.option("recursiveFileLookup", True).parquet(f"{old}/data")
    episodes = episode_rows(scan_jsonl(spark, f"{old}/meta/episodes.jsonl", episodes_schema))
    tasks = scan_jsonl(spark, f"{old}/meta/tasks.jsonl", tasks_schema)
    write_frames(frames, new)
    info = json.loads(read_text(spark, f"{old}/meta/info.json"))
    n = episodes.agg(F.count(F.lit(1)).alias("e"), F.sum("length").alias("f")).first()
    write_meta(spark, new, {**info, "codebase_version": "v3.0", "total_episodes": n["e"], "total_frames": n["f"], "splits": {"train": f"0:{n['e']}"}}, tasks, episodes)
