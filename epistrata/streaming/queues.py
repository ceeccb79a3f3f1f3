"""Keyed action and observation streams. Each has a batch form over a table of arrivals, and a stateful form for Structured Streaming with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from epistrata.runtime import c, delete_path


def merge_actions(current: DataFrame, incoming: DataFrame, latest: DataFrame, weights: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(robot, timestep, action): the new queue. Incoming steps at or before the latest executed one are dropped, steps in both queues are
    old * w0 + new * w1, and only incoming steps are in the result."""
    new = incoming.select("robot", "timestep", F.col("action").alias("__new"))
    out = new.join(latest.select("robot", "latest"), ["robot"], "left").filter(F.col("latest").isNull() | (F.col("timestep") > F.col("latest")))
    out = out.join(current.select("robot", "timestep", F.col("action").alias("__old")), ["robot", "timestep"], "left")
    mixed = F.zip_with("__old", "__new", lambda a, b: a.cast("double") * weights[0] + b.cast("double") * weights[1])
    return out.select("robot", "timestep", F.when(F.col("__old").isNull(), F.col("__new").cast("array<double>")).otherwise(mixed).alias("action"))


def merge_arrivals(arrivals: DataFrame, weights: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(robot, seq, timestep, action): the queue after every arrival, each merged into the one before as by merge_actions. rows: robot, seq, latest (executed
    when chunk seq arrives), timestep, action.

    A step's value is a fold over the unbroken run of arrivals that hold it up to this one, so no loop over arrivals is needed.
    """
    place = F.dense_rank().over(Window.partitionBy("robot").orderBy("seq"))
    kept = arrivals.withColumn("__c", place).filter(F.col("latest").isNull() | (F.col("timestep") > F.col("latest")))
    kept = kept.withColumn("__run", F.col("__c") - F.row_number().over(Window.partitionBy("robot", "timestep").orderBy("seq")))
    w = Window.partitionBy("robot", "timestep", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mix = lambda old, new: F.when(old["a"].isNull(), new).otherwise(F.struct(F.zip_with(old["a"], new["a"], lambda a, b: a * weights[0] + b * weights[1]).alias("a")))
    seen = F.collect_list(F.struct(F.col("action").cast("array<double>").alias("a"))).over(w)
    first = F.struct(F.lit(None).cast("array<double>").alias("a"))
    return kept.withColumn("__seen", seen).select("robot", "seq", "timestep", F.aggregate("__seen", first, mix)["a"].alias("action"))


def timed_chunk(df: DataFrame, dt: float) -> DataFrame:
    """A chunk of actions from time t0 and step i0 as rows t0 + k dt, i0 + k."""
    return df.select("robot", F.posexplode("chunk").alias("k", "action"), "t0", "i0").select("robot", (F.col("t0") + F.col("k") * dt).alias("timestamp"), (F.col("i0") + F.col("k")).alias("timestep"), "action")


def queue_after(df: DataFrame, replace: bool) -> DataFrame:
    """(robot, pos, action): the queue after its last merge. rows: robot, seq, consumed (before the merge), delay, chunk (array).

    With ``replace`` the last chunk without its first ``delay`` actions; else all chunks in order without what was consumed.
    """
    if replace:
        last = df.withColumn("__r", F.row_number().over(Window.partitionBy("robot").orderBy(F.desc("seq")))).filter("__r = 1")
        return last.select("robot", F.posexplode(F.slice("chunk", F.col("delay") + 1, F.greatest(F.size("chunk") - F.col("delay"), F.lit(0)))).alias("pos", "action"))
    flat = df.select("robot", "seq", F.posexplode("chunk").alias("k", "action"))
    used = df.groupBy("robot").agg(F.sum("consumed").alias("used"))
    v = Window.partitionBy("robot").orderBy("seq", "k")
    return flat.withColumn("__p", F.row_number().over(v) - 1).join(used, ["robot"]).filter(F.col("__p") >= F.col("used")).select("robot", (F.col("__p") - F.col("used")).cast("int").alias("pos"), "action")


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [n for n in df.columns if n != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*[c(n) for n in rest]), order).alias("__x")).select(key, "__x.*")


def ring_slots(df: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """What a ring buffer holds: the newest row of each slot seq % capacity."""
    rest = [n for n in df.columns if n != key]
    slot = F.pmod(c(seq), F.lit(capacity)).alias("slot")
    return df.groupBy(key, slot).agg(F.max_by(F.struct(*[c(n) for n in rest]), seq).alias("__x")).select(key, "slot", "__x.*")


def last_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """First-in first-out retention: the last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


class Retention:
    """The last rows of each key of a stream: ``write_batch`` is a foreachBatch function. The buffer after batch N is a folder of that number, made from the one
    before and the batch, so a retry replaces it and nothing grows with the stream. Repeated rows count once."""

    def __init__(self, root: str, key: str, order: list[str], n: int):
        self.root, self.key, self.order, self.n = root, key, order, n

    def _numbers(self, spark: SparkSession, below: int) -> list[int]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(k for k in (int(x.split("=")[1]) for x in names if x.startswith("batch_id=")) if k < below)

    def write_batch(self, batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, self._numbers(batch.sparkSession, number)
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{self.root}/batch_id={before[-1]}")) if before else batch
        last_rows(both.distinct(), self.key, self.order, self.n).write.mode("overwrite").parquet(f"{self.root}/batch_id={number}")
        for old in before[:-1]:
            delete_path(spark, f"{self.root}/batch_id={old}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/batch_id={self._numbers(spark, 1 << 62)[-1]}")


def queue_window(df: DataFrame, key: str, order: list[str], column: str, n: int) -> DataFrame:
    """Adds ``queue``: the last n values, the first one standing in before there are so many."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(c(column)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("queue", F.array(*[F.coalesce(F.lag(c(column), k).over(w), first) if k else c(column) for k in range(n - 1, -1, -1)]))


def rate_window(df: DataFrame, keys: list[str], end: str, ok: str, latency_ms: str, seconds: float = 1.0) -> DataFrame:
    """Adds what a trailing window says at each call's end: count, good, errors, hz, mean and max latency of the good ones."""
    w = Window.partitionBy(*keys).orderBy(end).rangeBetween(-seconds, 0)
    good = F.when(c(ok), c(latency_ms))
    n = F.count(F.lit(1)).over(w)
    return df.withColumns({"count": n, "good": F.count(good).over(w), "errors": n - F.count(good).over(w), "hz": F.round(n / seconds, 3), "mean_latency_ms": F.round(F.avg(good).over(w), 3), "max_latency_ms": F.round(F.max(good).over(w), 3)})


def counter_rate(df: DataFrame, key: str, time: str, counter: str) -> DataFrame:
    """Adds ``rate``: the counter's difference over the time's, 0 where time does not rise."""
    w = Window.partitionBy(key).orderBy(time, counter)
    dt, dx = c(time) - F.lag(c(time)).over(w), c(counter) - F.lag(c(counter)).over(w)
    return df.withColumn("rate", F.when(dt > 0, dx / F.when(dt > 0, dt)).otherwise(0.0))


def fresh_observations(pdf: pd.DataFrame, tolerance: float, seen: set[int], last: np.ndarray | None) -> tuple[list[bool], set[int], np.ndarray | None]:
    """Which observations are processed: not if their step was predicted already, or if they are within the tolerance of the last processed one; must_go and the very first always are."""
    out = []
    for step, vec, must in zip(pdf["timestep"], pdf["state"], pdf["must_go"]):
        v = np.asarray(vec, float)
        go = bool(must) or last is None or (int(step) not in seen and float(np.linalg.norm(v - last)) >= tolerance)
        out.append(go)
        if go:
            seen.add(int(step))
            last = v
    return out, seen, last


OBSERVATION = "robot long, seq long, timestep long, state array<double>, must_go boolean"


def dedup_observations(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(robot, seq, timestep): the observations that are processed, robot by robot in order of seq. Each decision depends on the last one taken, so no window can express it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        keep, _, _ = fresh_observations(pdf, tolerance, set(), None)
        return pdf.loc[keep, ["robot", "seq", "timestep"]]

    return df.groupBy("robot").applyInPandas(run, "robot long, seq long, timestep long")


def dedup_observation_stream(stream: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The same over a stream: the state of a robot is its last processed vector and the steps seen."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (set(state.get[0]), np.array(state.get[1]) if state.get[1] is not None else None) if state.exists else (set(), None)
        rows = pd.concat(list(batches)).sort_values("seq")
        keep, seen, last = fresh_observations(rows, tolerance, seen, last)
        state.update((sorted(seen), None if last is None else last.tolist()))
        yield rows.loc[keep, ["robot", "seq", "timestep"]]

    return stream.groupBy("robot").applyInPandasWithState(run, "robot long, seq long, timestep long", "seen array<bigint>, last array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_action_stream(stream: DataFrame, weights: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Chunks arriving on a stream (robot, seq, latest, timesteps, actions) merged into the robot's queue; emits the queue after each."""
    kind = "robot long, seq long, timestep long, action array<double>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue: dict[int, list[float]] = dict(zip(state.get[0], state.get[1])) if state.exists else {}
        out: list[tuple] = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            nxt: dict[int, list[float]] = {}
            for step, action in zip(r.timesteps, r.actions):
                if step <= r.latest:
                    continue
                old = queue.get(step)
                nxt[int(step)] = [float(x) for x in action] if old is None else [float(a * weights[0] + b * weights[1]) for a, b in zip(old, action)]
            queue = nxt
            out += [(r.robot, r.seq, s, a) for s, a in queue.items()]
        state.update((list(queue), list(queue.values())))
        yield pd.DataFrame(out, columns=["robot", "seq", "timestep", "action"])

    return stream.groupBy("robot").applyInPandasWithState(run, kind, "steps array<bigint>, actions array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame, time: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and tumbling or sliding event-time window, with a watermark."""
    win = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(win.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Session windows per key."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], Any] | None = None) -> None:
    """Run a stream over what is there and stop. Batches go to folders by number, so a retry replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        (each or (lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch_id={n}")))(batch, number)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def record_labels(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``mode`` and is_intervention of a recording: a toggle event switches between policy and human, a release goes back to the policy after one frame.

    event: 'toggle', 'release' or null. The mode is the parity of toggles so far since the last release.
    """
    w = Window.partitionBy(key).orderBy(*order)
    released = F.coalesce(F.sum(F.when(F.col("event") == "release", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("__g", released)
    v = Window.partitionBy(key, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    human = F.pmod(F.sum(F.when(F.col("event") == "toggle", 1).otherwise(0)).over(v), F.lit(2)) == 1
    return out.withColumn("is_intervention", human).withColumn("mode", F.when((F.col("event") == "release") & human, "release").when(human, "active").otherwise("policy")).drop("__g")
