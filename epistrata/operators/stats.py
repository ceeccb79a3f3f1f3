"""Per-feature statistics in long form (feature, dim), their merge, and exact and sketched quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.operators.quantiles import exact_quantiles
from epistrata.runtime import c, settled, with_one_row

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)
NAMES = ("q01", "q10", "q50", "q90", "q99")
#: Bins of the sketch.
BINS = 5000


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, dim, x): a row a number. Scalars have dim 0. Nulls, and NaN by decree, are no values."""
    parts = None
    for f in features:
        v = c(f) if df.schema[f].dataType.typeName() == "array" else F.array(c(f))
        rows = df.select(*[c(k) for k in keep], F.lit(f).alias("feature"), F.posexplode(v.cast("array<double>")).alias("dim", "x"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.filter("x is not null and not isnan(x)")


def feature_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """min, max, mean, std (population), count and quantiles per feature and dimension; with fewer than two values the quantiles are the mean.

    Exact quantiles hold at most a bounded number of values in a task (see quantiles.py); ``exact=False`` uses Spark's mergeable sketch in
    the same pass as the moments.
    """
    keys = [*by, "feature", "dim"]
    if exact and not by:
        df = settled(df.select(*[c(f) for f in features]), "features")
    x = long_form(df, features, by)
    moments = [F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count")]
    if exact:
        if not by:  # few groups: two passes over the columns
            s = x.groupBy("feature", "dim").agg(*moments).join(exact_quantiles(x, ["feature", "dim"], "x", QUANTILES), ["feature", "dim"])
        else:  # groups as small as episodes
            s = x.groupBy(*[c(k) for k in keys]).agg(*moments, F.percentile("x", F.array(*[F.lit(p) for p in QUANTILES])).alias("q"))
    else:
        s = x.groupBy(*[c(k) for k in keys]).agg(*moments, F.percentile_approx("x", [*QUANTILES], 10_000).alias("q"))
    return s.select(*[c(k) for k in keys], "min", "max", "mean", "std", "count", *[F.when(F.col("count") < 2, F.col("mean")).otherwise(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(NAMES)])


def merge_stats(parts: DataFrame, by: Sequence[str] = ("feature", "dim")) -> DataFrame:
    """Statistics of the union from statistics of its parts: min, max, weighted mean, parallel variance, count; quantiles as weighted means.

    Variance is summed around the merged mean (two passes), so it keeps its digits where std is small beside the mean.
    """
    keys = [c(k) for k in by]
    n, m = F.col("count"), F.col("mean")
    whole = parts.groupBy(*keys).agg((F.sum(n * m) / F.sum(n)).alias("__m"))
    near = parts.join(whole, list(by))
    quantiles = [(F.sum(n * c(q)) / F.sum(n)).alias(q) for q in NAMES if q in parts.columns]
    spread = F.sqrt(F.sum(n * (F.col("std") * F.col("std") + (m - F.col("__m")) * (m - F.col("__m")))) / F.sum(n))
    return near.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.first("__m").alias("mean"), spread.alias("std"), F.sum(n).alias("count"), *quantiles)


def invalid_stats(stats: DataFrame) -> DataFrame:
    """Rows that cannot be statistics: min above max, mean outside them, negative std or no count."""
    return stats.filter("min > max or mean < min - 1e-9 or mean > max + 1e-9 or std < 0 or count < 1 or min is null or max is null or mean is null or std is null or count is null")


def stats_override(computed: DataFrame, copied: DataFrame) -> DataFrame:
    """Computed statistics, and copied ones for the features that were not computed (media)."""
    return computed.unionByName(copied.join(computed.select("feature").distinct(), ["feature"], "left_anti"))


def sketched_stats(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Quantiles by a histogram of ``bins`` equal bins over each feature's range: bins are counted with map-side combine, so a group is at most ``bins`` rows. The quantile lies in the first bin whose running count reaches its rank, in proportion; in the lowest bin it is that bin's lower edge."""
    x = long_form(df, features)
    ends = x.groupBy("feature", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    near = x.join(F.broadcast(ends), ["feature", "dim"])  # one row a dimension of the schema
    low, width = F.col("lo") - 1e-10, (F.col("hi") - F.col("lo") + 2e-10) / bins
    counts = near.withColumn("bin", F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")).groupBy("feature", "dim", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))

    whole = Window.partitionBy("feature", "dim")  # at most ``bins`` rows
    placed = counts.withColumn("upto", F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("count", F.sum("n").over(whole))
    into = lambda q: (F.col("count") * q - (F.col("upto") - F.col("n"))) / F.col("n")
    value = lambda q: F.when(F.col("bin") == 0, low).otherwise(low + (F.col("bin") + into(q)) * width)
    found = [F.min(F.when(F.col("upto") >= F.col("count") * q, F.struct("bin", value(q).alias("x"))))["x"].alias(n) for q, n in zip(QUANTILES, NAMES)]
    return placed.groupBy("feature", "dim", "count").agg(*found).select("feature", "dim", "count", *NAMES)


def as_arrays(stats: DataFrame, feature: str) -> dict[str, list[float]]:
    """A feature's statistics as vectors by name; as many rows as it has dimensions."""
    rows = stats.filter(F.col("feature") == feature).orderBy("dim").collect()
    return {n: [float(r[n]) for r in rows] for n in ("min", "max", "mean", "std", *NAMES) if n in stats.columns}


def length_histogram(episodes: DataFrame, bins: int = 20, length: str = "length") -> DataFrame:
    """(bin, low, high, n): equal-width bins over the lengths' range, empty ones too; a range of zero puts all in bin 0."""
    ends = episodes.agg(F.min(length).cast("double").alias("lo"), F.max(length).cast("double").alias("hi"))
    near = with_one_row(episodes.select(F.col(length).cast("double").alias("x")).filter("x is not null"), ends)
    w = (F.col("hi") - F.col("lo")) / bins
    i = F.when(w > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.when(w > 0, w)), F.lit(bins - 1))).otherwise(0)
    counts = near.groupBy(i.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = with_one_row(episodes.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), ends)
    return every.join(counts, ["bin"], "left").select("bin", (F.col("lo") + F.col("bin") * w).alias("low"), (F.col("lo") + (F.col("bin") + 1) * w).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
