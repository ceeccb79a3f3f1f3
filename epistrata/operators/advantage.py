"""From value predictions to training indicators: targets, dense rewards, n-step advantages, thresholds; and progress-based weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.operators.quantiles import exact_quantiles
from epistrata.runtime import Workspace, c, lookup_join, settled, with_one_row


#: Frames of an episode that are one window's work; longer episodes are split.
PART_FRAMES = 8192


def in_parts(df: DataFrame, ahead: int, size: int = PART_FRAMES) -> DataFrame:
    """Frames partitioned by episode and stretch of ``size`` frames, each stretch with the ``ahead`` frames after it as ``halo``.

    Windows that look at most that far ahead then work on stretches, so an episode of any length is many tasks' work; episodes within one
    stretch gain no rows. Repeated rows of an index go, as this is the one shuffle. Rows without frame_index are a stretch by themselves.
    """
    p = F.floor(F.col("frame_index") / size)
    rows = df.withColumn("part", F.explode(F.when((p > 0) & (F.pmod(F.col("frame_index"), F.lit(size)) < ahead), F.array(p, p - 1)).otherwise(F.array(p))))
    rows = rows.withColumn("halo", F.coalesce(F.col("part") != p, F.lit(False)))
    return rows.repartition("episode_index", "part").dropDuplicates(["episode_index", "part", "index"])


def _keys(df: DataFrame) -> list[str]:
    return ["episode_index", "part"] if "part" in df.columns else ["episode_index"]


def runs(df: DataFrame) -> DataFrame:
    """Adds ``run``: equal for rows of an episode (or stretch) with consecutive frame_index."""
    w = Window.partitionBy(*_keys(df)).orderBy("frame_index", "index")
    return df.withColumn("run", F.col("frame_index") - F.row_number().over(w))


def _by_run(df: DataFrame) -> Window:
    return Window.partitionBy(*_keys(df), "run").orderBy("frame_index", "index")


def task_max_length(episodes: DataFrame) -> DataFrame:
    """(task, max_length): the longest episode per first task."""
    return episodes.select(F.get("tasks", F.lit(0)).alias("task"), "length").filter("task is not null").groupBy("task").agg(F.max("length").alias("max_length"))


def value_target(length: Column, frame: Column, longest: Column, success: Column, c_fail: float = 1.0, low: float = -1.0, high: float = 0.0) -> Column:
    """Minus the steps to go, minus a penalty for a failed episode, over the longest episode of the task; clipped."""
    t = longest.cast("double")
    raw = (-(length - frame - 1) - F.when(success, 0.0).otherwise(t * c_fail)) / (t * (1.0 + c_fail))
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def value_targets(frames: DataFrame, episodes: DataFrame, c_fail: float = 1.0) -> DataFrame:
    """Frames with ``target``. A frame whose episode or task length is unknown raises. episodes: episode_index, tasks, length, success (boolean)."""
    info = episodes.select("episode_index", "length", "success", F.get("tasks", F.lit(0)).alias("task"))
    info = lookup_join(info, task_max_length(episodes), ["task"], "left").drop("task")
    out = lookup_join(frames, info, ["episode_index"], "left")
    ok = F.assert_true(F.col("length").isNotNull() & F.col("max_length").isNotNull(), F.concat(F.lit("no episode "), F.col("episode_index").cast("string")))
    target = value_target(F.col("length"), F.col("frame_index"), F.col("max_length"), F.coalesce("success", F.lit(False)), c_fail)
    return out.withColumn("target", F.when(ok.isNull(), target)).drop("length", "success", "max_length")


def dense_rewards(df: DataFrame, target: str = "target") -> DataFrame:
    """Adds ``reward``: the target less that of the next frame of the run, the target itself at a run's end."""
    return df.withColumn("reward", F.col(target) - F.coalesce(F.lead(target).over(_by_run(df)), F.lit(0.0)))


def n_step_advantages(df: DataFrame, n: int = 50, value: str = "value", reward: str = "reward") -> DataFrame:
    """Adds ``advantage``: undiscounted sum of the next n rewards of the run, plus the value n steps on if the run reaches there, less the value."""
    w = _by_run(df)
    return df.withColumn("advantage", F.sum(reward).over(w.rowsBetween(0, n - 1)) + F.coalesce(F.lead(value, n).over(w), F.lit(0.0)) - F.col(value))


def task_thresholds(df: DataFrame, positive_ratio: float = 0.3, advantage: str = "advantage") -> DataFrame:
    """(task_index, threshold): the interpolated quantile at 1 - positive_ratio, exact for tasks of any size."""
    return exact_quantiles(df, ["task_index"], advantage, [1.0 - positive_ratio]).select("task_index", F.get("q", F.lit(0)).alias("threshold"))


def indicators(df: DataFrame, thresholds: DataFrame, force: bool = True, advantage: str = "advantage", intervention: str = "intervention") -> DataFrame:
    """Adds ``indicator``: 1 at or above the task's threshold, and where a human intervened if forced; else 0."""
    out = lookup_join(df, thresholds, ["task_index"], "left")
    above = F.when(F.col(advantage) >= F.col("threshold"), 1).otherwise(0)
    return out.withColumn("indicator", F.when(F.lit(force) & (F.coalesce(F.col(intervention), F.lit(0.0)) > 0.5), 1).otherwise(above)).drop("threshold")


def advantages(frames: DataFrame, episodes: DataFrame, n_step: int = 50, c_fail: float = 1.0) -> DataFrame:
    """target, reward and advantage of frames with a ``value`` column, long episodes in stretches."""
    rows = value_targets(in_parts(frames, n_step + 1), episodes, c_fail)
    out = n_step_advantages(dense_rewards(runs(rows)), n_step)
    return out.filter(~F.col("halo")).drop("run", "part", "halo")


def annotate(frames: DataFrame, episodes: DataFrame, n_step: int = 50, positive_ratio: float = 0.3, c_fail: float = 1.0, force: bool = True) -> DataFrame:
    """The whole chain over frames with a ``value`` column: target, reward, advantage, indicator. Advantages are written once and read for thresholds and indicators."""
    df = Workspace(frames.sparkSession, "annotate").save(advantages(frames, episodes, n_step, c_fail), "advantages")
    return indicators(df, task_thresholds(df, positive_ratio), force)


def indicator_summary(df: DataFrame, indicator: str = "indicator") -> DataFrame:
    """total, positives, invalid (neither 0 nor 1) and the share of positives."""
    x = F.col(indicator)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(x == 1).alias("positives"), F.count_if(x.isNull() | ~x.isin(0, 1)).alias("invalid"), F.try_divide(F.count_if(x == 1), F.count(F.lit(1))).alias("ratio"))


# --- progress-based weights ---


def progress_deltas(df: DataFrame, ahead: int, progress: str = "progress") -> DataFrame:
    """Adds ``delta``: progress ``ahead`` indices on (at most the last of the episode) less progress now; null where either is not known.

    Works on ``index`` values by a join with the index ahead, so gaps give null and not a neighbour, and no episode is gathered anywhere. Rows without an
    episode have no delta.
    """
    rows = settled(df.withColumn("__p", F.when(~F.isnan(progress), F.col(progress))), "progress")
    there = rows.groupBy("episode_index", (F.col("index") - ahead).alias("index")).agg(F.max("__p").alias("__there"))
    ends = rows.groupBy("episode_index").agg(F.max("index").alias("__last"), F.max_by(F.struct(F.col("__p").alias("p")), "index").alias("__end"))
    near = lookup_join(rows.join(there, ["episode_index", "index"], "left"), ends, ["episode_index"], "left")
    delta = F.when(F.col("index") + ahead > F.col("__last"), F.col("__end.p")).otherwise(F.col("__there")) - F.col("__p")
    return near.withColumn("delta", delta).select(*[c(n) for n in df.columns], "delta")


def delta_moments(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: mean floored at 0 and std floored at eps over the known deltas."""
    return df.filter("delta is not null").agg(F.greatest(F.coalesce(F.avg("delta"), F.lit(0.0)), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.stddev_pop("delta"), F.lit(0.0)), F.lit(eps)).alias("std"))


def progress_weights(df: DataFrame, kappa: float = 0.01, eps: float = 1e-6, fallback: float = 1.0) -> DataFrame:
    """Adds ``weight``: 1 above kappa, a soft share between 0 and kappa, 0 below 0, the fallback where the delta is not known."""
    df = settled(df, "weights")
    near = with_one_row(df, delta_moments(df, eps))
    d = F.col("delta")
    soft = (d - (F.col("mean") - 2 * F.col("std"))) / (4 * F.col("std") + eps)
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), soft))
    return near.withColumn("weight", F.when(d.isNull(), fallback).when(d > kappa, 1.0).when(d >= 0, soft).otherwise(0.0)).drop("mean", "std")


def batch_weights(df: DataFrame, batch: str = "batch", eps: float = 1e-6) -> DataFrame:
    """Adds ``batch_weight``: weights of a batch scaled to sum to its size."""
    w = Window.partitionBy(batch)
    return df.withColumn("batch_weight", F.col("weight") * F.count(F.lit(1)).over(w) / (F.sum("weight").over(w) + eps))
