"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistrata.runtime import Workspace, c, lookup_join, with_one_row

#: Distinct values of a group that one task may hold.
HELD_VALUES = 500_000
#: Relative rank error of the sketch that narrows larger groups, as its inverse.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], held: int | None = None) -> DataFrame:
    """(keys, q): the quantiles of each group as an array, interpolated linearly between neighbouring values.

    Values are first counted by distinct value with map-side combine. A group of at most HELD_VALUES distinct values is finished
    from these counts. In larger ones every wanted quantile gets a bracket of values: a mergeable sketch over the values inside
    places it, an exact count of what lies below checks it, and each round leaves about 2 / ACCURACY of the values, until they can be held. A
    bracket that a sketch does not narrow is halved in the order of doubles, so at most 64 rounds more end every search.
    So no task holds a whole group, and the result is exact. Null and NaN are no values; a group without values is left out.
    """
    held = held or HELD_VALUES
    spark = df.sparkSession
    ws = Workspace(spark, "quantiles")
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[c(k).alias(n) for k, n in zip(keys, names)], c(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    counts = ws.save(rows.groupBy(*names, "x").agg(F.count(F.lit(1)).alias("m")), "counts")
    sizes = counts.groupBy(*names).agg(F.count(F.lit(1)).alias("d"), F.sum("m").alias("n"))
    most = sizes.agg(F.max("d")).first()[0] or 0
    back = [c(n).alias(k) for k, n in zip(keys, names)]
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    if most <= held:
        return counts.groupBy(*names).agg(F.percentile("x", qs, F.col("m")).alias("q")).select(*back, "q")
    sizes = ws.save(sizes, "sizes")
    parts = []
    for j, q in enumerate(quantiles):
        parts.append(_one(ws, counts, sizes, names, float(q), held).select(*names, F.lit(j).alias("j"), "x"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("q")).select(*back, "q")  # one value a quantile


def _join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """By group; null is a group too."""
    if not names:
        return with_one_row(left, right)
    coded = [F.coalesce(F.struct(*[c(n) for n in names]).cast("string"), F.lit("")).alias("__g")]
    return lookup_join(left.select("*", *coded), right.select(*coded, *[c(n) for n in right.columns if n not in names]), ["__g"]).drop("__g")


def _ordinal(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = np.asarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _middles(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the middle of each bracket in the order of doubles."""
    for pdf in it:
        a, b = _ordinal(pdf["lo0"].to_numpy(float)), _ordinal(pdf["hi0"].to_numpy(float))
        mid = (a >> 1) + (b >> 1) + (a & b & 1)
        yield pdf.assign(mid=np.where(mid < 0, np.int64(-(2**63)) - mid, mid).astype(np.int64).view(np.float64))


def _one(ws: Workspace, counts: DataFrame, sizes: DataFrame, names: list[str], q: float, held: int) -> DataFrame:
    """The quantile at q of each group, by narrowing brackets lo <= x <= hi around its rank."""
    pos = (F.col("n") - 1) * F.lit(q)
    inf = F.lit(float("inf"))
    state = ws.save(sizes.select(*names, pos.alias("pos"), (-inf).alias("lo"), inf.alias("hi")), "state")
    inside: Column = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    while True:
        near = _join(counts, state, names)
        view = near.groupBy(*names).agg(F.first("pos").alias("pos"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.coalesce(F.sum(F.when(F.col("x") < F.col("lo"), F.col("m"))), F.lit(0)).alias("below"), F.sum(F.when(inside, F.col("m"))).alias("m"), F.count_if(inside).alias("d"))
        view = ws.save(view, "view")
        if (view.agg(F.max("d")).first()[0] or 0) <= held:
            break
        # ranks inside the bracket, a sketch error to both sides, of the two values that are interpolated
        r0, r1 = (F.floor("pos") - F.col("below")) / F.col("m"), (F.ceil("pos") - F.col("below") + 1) / F.col("m")
        marks = _join(counts, view.select(*names, "lo", "hi"), names).filter(inside)
        # distinct values stand for themselves as often as they occur, up to what moves a rank by less than the sketch's error
        sketch = _join(marks, view.select(*names, F.greatest(F.lit(1), F.floor(F.col("m") / (ACCURACY * 100.0))).alias("unit")), names)
        sketch = sketch.select(*names, "x", F.explode(F.array_repeat(F.lit(1), F.greatest(F.lit(1), F.round(F.col("m") / F.col("unit"))).cast("int")))).groupBy(*names).agg(F.percentile_approx("x", [i / 200 for i in range(201)], ACCURACY).alias("grid"))
        nxt = _join(view, sketch, names)
        lo_i = F.greatest(F.lit(0), F.floor((r0 - 0.01) * 200)).cast("int")
        hi_i = F.least(F.lit(200), F.ceil((r1 + 0.01) * 200)).cast("int")
        nxt = nxt.select(*names, "pos", F.when(lo_i <= 0, F.col("lo")).otherwise(F.get("grid", lo_i)).alias("lo"), F.when(hi_i >= 200, F.col("hi")).otherwise(F.get("grid", hi_i)).alias("hi"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
        nxt = nxt.mapInPandas(_middles, T.StructType([*nxt.schema.fields, T.StructField("mid", T.DoubleType())]))  # one row a group
        # a bracket that lost its ranks (a sketch worse than promised) or did not move is halved instead
        upto = lambda cond, m="m": F.coalesce(F.sum(F.when(cond, F.col(m))), F.lit(0))
        x = F.col("x")
        check = _join(counts, nxt, names).groupBy(*names).agg(*[F.first(k).alias(k) for k in ("pos", "lo", "hi", "lo0", "hi0")], upto(x < F.col("lo")).alias("b"), upto(x <= F.col("hi")).alias("u"), upto(x <= F.col("mid")).alias("h"), F.max(F.when(x <= F.col("mid"), x)).alias("under"), F.min(F.when(x > F.col("mid"), x)).alias("over"))
        moved = (F.col("lo") != F.col("lo0")) | (F.col("hi") != F.col("hi0"))
        ok = (F.col("b") <= F.floor("pos")) & (F.col("u") >= F.ceil("pos") + 1) & moved
        low, high = F.col("h") > F.ceil("pos"), F.col("h") <= F.floor("pos")
        state = ws.save(check.select(*names, "pos", F.when(ok, F.col("lo")).when(low, F.col("lo0")).when(high, F.col("over")).otherwise(F.col("under")).alias("lo"), F.when(ok, F.col("hi")).when(low, F.col("under")).when(high, F.col("hi0")).otherwise(F.col("over")).alias("hi")), "state")
    last = _join(counts, view.select(*names, "pos", "lo", "hi", "below"), names).filter(inside)
    values = last.groupBy(*names).agg(F.first("pos").alias("pos"), F.first("below").alias("below"), F.sort_array(F.collect_list(F.struct("x", "m"))).alias("v"))  # at most ``held`` values
    upto = F.aggregate("v", F.struct(F.col("below").alias("n"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")), lambda s, e: F.struct((s["n"] + e["m"]).alias("n"), F.when(s["a"].isNull() & (s["n"] + e["m"] > F.floor("pos")), e["x"]).otherwise(s["a"]).alias("a"), F.when(s["b"].isNull() & (s["n"] + e["m"] > F.ceil("pos")), e["x"]).otherwise(s["b"]).alias("b")))
    return values.select(*names, upto.alias("u"), "pos").select(*names, (F.col("u.a") + (F.col("u.b") - F.col("u.a")) * (F.col("pos") - F.floor("pos"))).alias("x"))
