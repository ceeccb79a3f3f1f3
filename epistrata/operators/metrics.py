"""Error metrics, rollups, latencies and the dataset report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.functions import arrays, text
from epistrata.operators.quantiles import exact_quantiles
from epistrata.operators.stats import length_histogram
from epistrata.runtime import c, with_one_row


def _with_quantiles(out: DataFrame, rows: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Adds exact quantiles of columns of rows by name; a group without values has null."""
    for column, names in wanted.items():
        q = exact_quantiles(rows, keys, column, list(names.values())).withColumnRenamed("q", "__q")
        near = out.join(q, list(keys), "left") if keys else with_one_row(out, q)
        out = near.select(*[c(n) for n in out.columns], *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out


def action_error(df: DataFrame, pred: str, target: str, which: Sequence[int]) -> DataFrame:
    """One row: frames, mae, rmse, L2 mean, median and p90, target L2, relative L2 over some dimensions."""
    d = [arrays.at(c(pred), i) - arrays.at(c(target), i) for i in which]
    rows = df.select((sum((F.abs(x) for x in d), F.lit(0.0)) / len(d)).alias("a"), (sum((x * x for x in d), F.lit(0.0)) / len(d)).alias("s"), arrays.norm(c(target), which).alias("t"))
    rows = rows.withColumn("l2", F.sqrt(F.col("s") * len(d)))
    out = rows.agg(F.count("s").alias("frames"), F.avg("a").alias("mae"), F.sqrt(F.avg("s")).alias("rmse"), F.avg("l2").alias("l2_mean"), F.avg("t").alias("target_l2"), (F.avg("l2") / (F.avg("t") + 1e-8)).alias("relative_l2"))
    return _with_quantiles(out, rows, [], {"l2": {"l2_median": 0.5, "l2_p90": 0.9}})


def per_dim_error(df: DataFrame, pred: str, target: str, which: Sequence[int]) -> DataFrame:
    """(dim, mae, pred_mean, target_mean)."""
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), arrays.at(c(pred), i).alias("p"), arrays.at(c(target), i).alias("t")) for i in which])).alias("e")
    return df.select(e).select("e.*").groupBy("dim").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.avg("p").alias("pred_mean"), F.avg("t").alias("target_mean"))


def arm_usage(df: DataFrame, left: Sequence[int], right: Sequence[int], threshold: float, action: str = "action") -> DataFrame:
    """Mean and p90 motion of both arms, which dominates how often, and how often each is active; the left one is expected to act."""
    a, b = arrays.norm(c(action), left), arrays.norm(c(action), right)
    rows = df.filter(c(action).isNotNull()).select(a.alias("a"), b.alias("b"))
    share = lambda cond: F.avg(cond.cast("double"))
    x, y = F.col("a"), F.col("b")
    out = rows.agg(F.avg(x).alias("left_mean"), F.avg(y).alias("right_mean"), F.avg(y / (x + 1e-8)).alias("wrong_over_correct"), share(x > y).alias("left_dominant"), share(y > x).alias("right_dominant"), share(x > threshold).alias("left_active"), share(y > threshold).alias("right_active"))
    return _with_quantiles(out, rows, [], {"a": {"left_p90": 0.9}, "b": {"right_p90": 0.9}})


def rollout_summary(df: DataFrame) -> DataFrame:
    """Per episode sum and largest reward and success over steps up to the first done. Columns: episode_index, frame_index, reward, success, done."""
    first = F.min(F.when(F.col("done"), F.col("frame_index"))).over(Window.partitionBy("episode_index"))
    kept = df.withColumn("__d", first).filter(F.col("__d").isNull() | (F.col("frame_index") <= F.col("__d")))
    return kept.groupBy("episode_index").agg(F.sum("reward").alias("sum_reward"), F.max("reward").alias("max_reward"), F.bool_or("success").alias("success"))


def eval_rollups(df: DataFrame, group: str, task: str) -> DataFrame:
    """Means of sum_reward and max_reward and percent success per (group, task), per group and over all; NaN is no value."""
    num = lambda n: F.avg(F.when(~F.isnan(n), F.col(n)))
    rows = df.select(c(group).alias("grp"), c(task).alias("tsk"), "sum_reward", "max_reward", "success")
    out = rows.groupingSets([["grp", "tsk"], ["grp"], []], "grp", "tsk").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("episodes"), num("sum_reward").alias("avg_sum_reward"), num("max_reward").alias("avg_max_reward"), F.avg(F.col("success").cast("double") * 100).alias("pc_success"))
    return out


def latency_summary(df: DataFrame, key: str, start: str, latency: str) -> DataFrame:
    """Per key: calls, rate over the span, latency mean, p50, p95, max, and mean and p95 of the time between calls."""
    w = Window.partitionBy(key).orderBy(start, latency)
    rows = df.withColumn("__gap", c(start) - F.lag(c(start)).over(w))
    span = F.max(start) - F.min(start)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.when(span > 1e-6, (F.count(F.lit(1)) - 1) / F.when(span > 1e-6, span)).otherwise(0.0).alias("hz"), F.avg(latency).alias("mean"), F.max(latency).alias("max"), F.avg("__gap").alias("gap_mean"))
    return _with_quantiles(out, rows, [key], {latency: {"p50": 0.5, "p95": 0.95}, "__gap": {"gap_p95": 0.95}})


def latency_tracker(df: DataFrame, key: str, order: Sequence[str], latency: str, last: int = 100, q: float = 0.95) -> DataFrame:
    """Adds p (quantile of the last ``last`` samples) and peak (largest ever). Negative and null samples are not recorded, so their rows are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    ok = df.filter(c(latency) >= 0)
    recent = F.sort_array(F.collect_list(latency).over(w.rowsBetween(-(last - 1), 0)))  # at most ``last`` values
    pos = (F.size(recent) - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    a, b = F.get(recent, lo), F.get(recent, F.least(lo + 1, F.size(recent) - 1))
    return ok.withColumn("p", a + (b - a) * (pos - lo)).withColumn("peak", F.max(latency).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_timer(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds total and running mean."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(value).over(w)).withColumn("running_mean", F.avg(value).over(w))


def joint_limits(df: DataFrame, column: str, dims: int, warm_up: float) -> DataFrame:
    """(dim, low, high) over frames at or after the warm-up, to 4 places."""
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), arrays.at(c(column), i).alias("x")) for i in range(dims)])).alias("e")
    return df.filter(F.col("timestamp") >= warm_up).select(e).select("e.*").groupBy("dim").agg(F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"))


def compression(df: DataFrame, tokens: str, numbers: int) -> DataFrame:
    """Mean, p99, least and most tokens of a chunk, and numbers a token."""
    return df.agg(F.avg(tokens).alias("mean"), F.percentile(tokens, 0.99).alias("p99"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), (F.lit(float(numbers)) / F.avg(tokens)).alias("ratio"))


def temporal_shares(segments: DataFrame) -> DataFrame:
    """(segment, share): mean over episodes of a segment's part of the episode's annotated time, summing to 1.

    Of segments of one name in an episode the last counts, while the episode's total keeps all.
    """
    d = segments.select("episode_index", "segment", "start", (F.col("end") - F.col("start")).cast("double").alias("d"))
    per = d.groupBy("episode_index", "segment").agg(F.max_by("d", "start").alias("d"), F.sum("d").alias("all"))
    w = Window.partitionBy("episode_index")
    share = per.withColumn("p", F.col("d") / F.when(F.sum("all").over(w) > 0, F.sum("all").over(w))).filter("p is not null").groupBy("segment").agg(F.avg("p").alias("p"))
    return share.select("segment", (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("share"))  # a row a segment name


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(c(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def dataset_report(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: episodes, outcomes and their ratios, interventions (above 0), lengths in seconds, tasks. frames: index, episode_index, intervention; episodes: label, length, fps, tasks."""
    ok, bad = F.col("label") == "success", F.col("label") == "failure"
    seconds = F.col("length") / F.col("fps")
    e = episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(ok).alias("success"), F.count_if(bad).alias("failure"), F.count_if(~F.coalesce(ok | bad, F.lit(False))).alias("unlabeled"),
        F.avg(seconds).alias("mean_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"), F.count_distinct(F.get("tasks", F.lit(0))).alias("tasks"),
    )
    i = F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.0
    f = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(i).alias("k")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.coalesce(F.sum("k"), F.lit(0)).alias("intervention_frames"), F.count(F.when(F.col("k") > 0, 1)).alias("intervention_episodes"))
    both = with_one_row(e, f)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("*", ratio(F.col("success"), F.col("episodes")).alias("success_ratio"), ratio(F.col("success"), F.col("success") + F.col("failure")).alias("labeled_success_ratio"), ratio(F.col("intervention_frames"), F.col("frames")).alias("intervention_ratio"), ratio(F.col("intervention_episodes"), F.col("episodes")).alias("intervention_episode_ratio"))


def ordered_tasks(episodes: DataFrame) -> DataFrame:
    """(task, first_episode): distinct tasks by the episode that has them first."""
    return episodes.select("episode_index", F.explode(text.flat_tasks(F.col("tasks"))).alias("task")).groupBy("task").agg(F.min("episode_index").alias("first_episode"))


def text_report(report: DataFrame, episodes: DataFrame, width: int = 40) -> str:
    """The report row and the histogram of lengths as text."""
    row = report.first().asDict()
    lines = [f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items()]
    bars = length_histogram(episodes).orderBy("bin").collect()
    most = max((b["n"] for b in bars), default=0)
    lines += [f"[{b['low'] or 0:8.1f}, {b['high'] or 0:8.1f}) {b['n']:6d} " + "#" * (round(width * b["n"] / most) if most else 0) for b in bars]
    return "\n".join(lines)


def log_losses(lines: DataFrame, column: str = "line") -> DataFrame:
    """(job, step, loss) of log lines ``job=... step:N ... loss:X``."""
    got = lambda p: F.nullif(F.regexp_extract(c(column), p, 1), F.lit(""))
    return lines.select(got(r"job=(\S+)").alias("job"), got(r"step:(\d+)").cast("long").alias("step"), got(r"loss:([0-9.eE+-]+)").cast("double").alias("loss")).filter("step is not null and loss is not null")


def loss_progress(losses: DataFrame, edge: int = 10, tail: int = 20, least_gain: float = 0.02) -> DataFrame:
    """Per job mean of the first and last ``edge`` losses, least of the last ``tail``, and whether to stop for lack of progress."""
    w = Window.partitionBy("job")
    up, down = F.row_number().over(w.orderBy("step", "loss")), F.row_number().over(w.orderBy(F.desc("step"), F.desc("loss")))
    r = losses.withColumn("u", up).withColumn("d", down)
    out = r.groupBy("job").agg(F.avg(F.when(F.col("u") <= edge, F.col("loss"))).alias("first"), F.avg(F.when(F.col("d") <= edge, F.col("loss"))).alias("last"), F.min(F.when(F.col("d") <= tail, F.col("loss"))).alias("least_recent"))
    return out.withColumn("stop", F.col("last") > F.col("first") * (1 - least_gain))


def image_error(df: DataFrame, a: str, b: str, peak: float = 255.0) -> DataFrame:
    """Adds mse and psnr of two pixel arrays."""
    d = F.zip_with(c(a), c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    mse = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(c(a))
    return df.withColumn("mse", mse).withColumn("psnr", F.when(F.col("mse") > 0, 10.0 * F.log10(F.lit(peak * peak) / F.when(F.col("mse") > 0, F.col("mse")))))
