"""Far too many small files: a checkpointed streaming compactor."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.runtime import delete_path, shared_dir

#: Bytes of records a written file should have.
TARGET_BYTES = 128 << 20
KEY = ["episode_index", "index"]
RECORDS = "file_id long, line_no int, episode_index long, index long, record string"
_SCHEMA = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("episode_index", pa.int64()), ("index", pa.int64()), ("record", pa.string())])
_LINES = re.compile(r"\r\n|\n|\r")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def _reject(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_float=Decimal, parse_constant=_reject)


def whole_number(v: Any) -> int | None:
    """A 64-bit whole number however it is written: 7, 7.0, 7e0, "7"; None for anything else."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        if not _NUMBER.fullmatch(v.strip()):
            return None
        try:
            v = Decimal(v.strip())
        except InvalidOperation:
            return None
    if isinstance(v, Decimal):
        if not v.is_finite() or v.adjusted() > 20 or v != v.to_integral_value():
            return None
        v = int(v)
    return v if isinstance(v, int) and -(2**63) <= v < 2**63 else None


def parse_lines(payload: str) -> Iterator[tuple[int, int, int, str]]:
    """(line number, episode_index, index, record) of every line that is a complete JSON object with both numbers."""
    for n, line in enumerate(_LINES.split(payload)):
        line = line.replace("﻿", "").strip() if "﻿" in line[:8] or "﻿" in line[-1:] else line.strip()
        if not line.startswith("{"):
            continue
        try:
            o, end = _decoder.raw_decode(line)
        except (ValueError, RecursionError):
            continue
        if end != len(line) or not isinstance(o, dict):
            continue
        e, i = whole_number(o.get("episode_index")), whole_number(o.get("index"))
        if e is not None and i is not None:
            yield n, e, i, line


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(f, *r) for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p for r in parse_lines(p)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def records_of(files: DataFrame) -> DataFrame:
    """The records in the payloads of (file_id, payload)."""
    return files.select(F.col("file_id").cast("long"), "payload").mapInArrow(_parse, RECORDS)


@dataclass
class Compacted:
    """records: every record once, in files of good size. duplicates: keys that occurred more than once."""

    records: DataFrame
    duplicates: DataFrame


class Compactor:
    """Consolidates a stream of small files under ``root``.

    Spark's file source and the checkpoint log discover every file exactly once and number the batches; a batch that is
    retried has the same number and the same files. Each batch writes whole folders named by its number,
    ``data/batch_id=N`` and ``duplicates/batch_id=N``, and replaces them if they exist, so a retry after any crash leaves neither gaps nor copies.

    Within a batch, records are first reduced to one a key (map-side, then by key, so a key sent a billion times is no hot
    task), then freed of those that earlier batches wrote, by an anti-join with the keys in their folders. Keys are sorted in the
    files, so the scan of the earlier ones reads only row groups in the batch's range of episodes. Files are cut by range of key at
    TARGET_BYTES, so one episode may fill many files.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes

    def _earlier(self, kind: str, batch: int) -> list[str]:
        """Folders of batches before this one, by their numbers; what a later, abandoned run left is not read."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = sorted(int(n.split("=")[1]) for n in names if re.fullmatch(r"batch_id=\d+", n))
        return [f"{self.root}/{kind}/batch_id={k}" for k in found if k < batch]

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """Compact one batch of (file_id, payload); the same batch under the same number gives the same folders."""
        spark = batch.sparkSession
        staged = f"{self.root}/staging/batch_id={number}"
        one = records_of(batch).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_id", "line_no", "record")).alias("r"))
        one.select(*KEY, "n", "r.file_id", "r.line_no", "r.record").write.mode("overwrite").parquet(staged)
        one = spark.read.parquet(staged)
        sizes = one.agg(F.sum(F.octet_length("record") + 40).alias("b"), F.min("episode_index").alias("lo"), F.max("episode_index").alias("hi")).first()
        done = self._earlier("data", number)
        fresh, again = one, one.filter("n > 1").select(*KEY)
        if done and sizes["b"]:
            # one row a key on both sides, so no key is hot
            known = spark.read.parquet(*done).filter(F.col("episode_index").between(sizes["lo"], sizes["hi"])).select(*KEY)
            again = again.union(one.join(known, KEY, "left_semi").select(*KEY)).distinct()
            fresh = one.join(known, KEY, "left_anti")
        files = max(1, math.ceil((sizes["b"] or 0) / self.target))
        fresh.select(*KEY, "file_id", "line_no", "record").repartitionByRange(files, *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{self.root}/data/batch_id={number}")
        again.repartition(files).write.mode("overwrite").parquet(f"{self.root}/duplicates/batch_id={number}")
        delete_path(spark, staged)

    def run(self, stream: DataFrame) -> Compacted:
        """Process what is there and return. Run again on the same root to take up new files only."""
        query = stream.select("file_id", "payload").writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.result()

    def result(self) -> Compacted:
        """What all batches so far wrote."""
        spark = self.spark
        data, dups = self._earlier("data", 1 << 62), self._earlier("duplicates", 1 << 62)
        none = spark.createDataFrame([], "episode_index long, index long, file_id long, line_no int, record string")
        records = spark.read.schema(none.schema).parquet(*data) if data else none
        keys = none.select(*KEY)
        return Compacted(records, (spark.read.schema(keys.schema).parquet(*dups) if dups else keys).distinct())


def payload_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Stream of a table of (file_id, payload) rows: a Parquet file or a folder of them."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # the file source takes a single file only by a pattern
    return spark.readStream.schema("file_id long, payload string").option("maxFilesPerTrigger", max_files).parquet(pattern)


def jsonl_stream(spark: SparkSession, path: str, max_files: int = 100_000) -> DataFrame:
    """Stream of a folder tree of small JSON-lines files; file_id is a hash of the path."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("file_id"), F.col("value").alias("payload"))


def compact_small_files(stream: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> Compacted:
    """Compact a stream of (file_id, payload) into few files, each record exactly once.

    A record is a line that, apart from a byte-order mark, is a complete JSON object; its key is ``episode_index`` and ``index`` by value, however
    the numbers are written. Of equal keys the record of the smallest file_id and line is kept. Null and empty payloads, blank,
    cut-off and other lines, and objects without both numbers (null, fractions, beyond 64 bits) hold no record. A file whose row is sent twice holds each record
    twice. No input gives no records. ``root`` defaults to a folder of its own in the shared folder; give one to compact incrementally.
    """
    import uuid

    spark = stream.sparkSession
    return Compactor(spark, root or f"{shared_dir(spark)}/epistrata/compact-{uuid.uuid4().hex[:12]}", target_bytes).run(stream)
