"""Written tables that cut lineage, and joins that stay balanced when one key holds a third of the rows."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is called hot from this many rows on; below it one task handles the key easily.
HOT_ROWS = 200_000
#: So many of the largest hot keys are split. Any other has less than 1/HOT_KEYS of all rows, a fair share of one task.
HOT_KEYS = 4096
#: A side is broadcast only after a count showed at most so many rows.
LOOKUP_ROWS = 20_000
#: Operators in a plan that make it dear to run twice; a plan of only scans, filters and projections is counted as it is.
_DEAR = re.compile(r"\b(Aggregate|Join|Window|Deduplicate|Distinct|Generate|Sort|Repartition\w*|RebalancePartitions|MapIn\w+|FlatMap\w+|ArrowEvalPython|BatchEvalPython)\b")

_own_dirs: dict[str, str] = {}
_open: list["Workspace"] = []


def c(name: str) -> Column:
    """Column by its literal name: names hold dots and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a temporary one only for a local master where that is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="epistrata-")
        atexit.register(shutil.rmtree, path, True)
        _own_dirs[app] = "file://" + path
    return _own_dirs[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Intermediate tables of one operator call, written as Parquet into the shared folder.

    A lost executor costs only the tasks it ran: every later step reads files, not its memory. Results are read lazily from
    these tables, so whoever has used them up calls ``close``, or ``release`` for all of a session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/epistrata/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        _open.append(self)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}-{uuid.uuid4().hex[:6]}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back."""
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables nobody reads any more."""
        for df in dfs:
            path = self._paths.pop(id(df), None)
            if path:
                delete_path(self.spark, path)

    def close(self) -> None:
        """Delete all tables of this call; what was read from them can be read no more."""
        self._paths.clear()
        delete_path(self.spark, self.root)
        if self in _open:
            _open.remove(self)


def release(spark: SparkSession) -> None:
    """Close every workspace that operators opened in this session."""
    for ws in [w for w in _open if w.spark is spark]:
        ws.close()


def is_dear(df: DataFrame) -> bool:
    """Whether running this plan twice costs more than reading its columns twice."""
    return bool(_DEAR.search(df._jdf.queryExecution().analyzed().toString()))


def settled(df: DataFrame, name: str) -> DataFrame:
    """df itself if it only scans, filters and projects; else written once, so a count and a join do not both compute it."""
    return Workspace(df.sparkSession, name).save(df, name) if is_dear(df) else df


def hot_parts(df: DataFrame, on: list[str], rows: int | None = None) -> dict[int, int]:
    """Hash of a hot key -> parts to split it into; keys are counted with map-side combine.

    A part has at most HOT_ROWS rows, or 1/HOT_KEYS of all rows if that is more, so parts follow the counts and the
    driver gets at most HOT_KEYS numbers. Two keys with one hash are only split together, which changes no result.
    """
    if rows is not None and rows < HOT_ROWS:
        return {}
    counts = df.groupBy(F.xxhash64(*[c(k) for k in on]).alias("h")).count().filter(F.col("count") >= HOT_ROWS)
    found = counts.orderBy(F.desc("count"), "h").limit(HOT_KEYS).collect()
    unit = max(HOT_ROWS, sum(r["count"] for r in found) // HOT_KEYS)
    return {r["h"]: max(2, -(-r["count"] // unit)) for r in found}


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", left_rows: int | None = None) -> DataFrame:
    """Equi-join of a side that may be skewed with a side of few rows a key.

    Hot keys of ``left`` are split into parts by a hash of the row (so a task that runs again
    sends every row to the same place), and the matching rows of ``right`` are repeated for each part.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing, as in SQL. A left side that is dear
    to compute is written once, so counting its keys does not compute it again; below HOT_ROWS ``left_rows``, where known, nothing is counted.
    """
    if left_rows is None or left_rows >= HOT_ROWS:
        left = settled(left, "left")
    parts = hot_parts(left.select(*[c(k) for k in on]), on, left_rows)
    if not parts:
        return left.join(right, on, how)
    listed = F.broadcast(left.sparkSession.createDataFrame(list(parts.items()), "__h long, __n int"))  # at most HOT_KEYS rows
    key = F.xxhash64(*[c(k) for k in on])
    spread = F.coalesce(F.pmod(F.xxhash64(*[c(k) for k in left.columns]), F.col("__n")), F.lit(0)).cast("int")
    salted = left.withColumn("__h", key).join(listed, ["__h"], "left").withColumn("__salt", spread).drop("__h", "__n")
    repeated = right.withColumn("__h", key).join(listed, ["__h"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__h", "__n")
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is usually small: broadcast if a count shows at most LOOKUP_ROWS rows, else hot_join.

    The table is written once if it is dear to compute, and its rows are counted where they are.
    """
    right = settled(right, "lookup")
    if right.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return left.join(F.broadcast(right), on, how)
    return hot_join(left, right, on, how)


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row table, as one scalar subquery; nulls if it has no row."""
    whole = one.select(F.struct(*[c(n) for n in one.columns]).alias("__one")).scalar()
    return df.withColumn("__one", whole).select(*[c(n) for n in df.columns], *[F.col("__one")[n].alias(n) for n in one.columns])
