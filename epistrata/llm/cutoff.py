"""Cutoff that keeps a target fraction of each source's records, without sorting them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrata.runtime import Workspace, c, lookup_join

#: Scores tried for a source in one pass over the data.
PIVOTS = 3
STATE = "s long, n long, k long, lo double, hi double, ge_lo long, ge_hi long, f_lo double, f_hi double, g_lo double, g_hi double, p0 double, p1 double, p2 double, cutoff double, kept long, by long"


def _ordinal(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    b = np.asarray(x, np.float64).view(np.int64)
    return np.where(b < 0, np.int64(-(2**63)) - b, b)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(2**63)) - i, i).astype(np.int64).view(np.float64)


def _pivots(s: pd.DataFrame) -> pd.DataFrame:
    """Where to look next in the open bracket lo < score <= hi.

    p0: where the tangents of the pinball loss at both ends meet (its cutting-plane minimum); p1: by counts; p2: the middle in
    the order of doubles, which bounds the passes by the bits of a double whatever the scores are.
    """
    lo, hi = s["lo"].to_numpy(float), s["hi"].to_numpy(float)
    with np.errstate(all="ignore"):
        bottom = s["g_lo"].to_numpy(float) - s["g_hi"].to_numpy(float)
        meet = (s["f_hi"].to_numpy(float) - s["f_lo"].to_numpy(float) + s["g_lo"].to_numpy(float) * lo - s["g_hi"].to_numpy(float) * hi) / bottom
        ge_lo, ge_hi, k = s["ge_lo"].to_numpy(float), s["ge_hi"].to_numpy(float), s["k"].to_numpy(float)
        by_count = lo + (hi - lo) * np.clip((ge_lo - k + 0.5) / np.maximum(ge_lo - ge_hi, 1), 0.001, 0.999)
    a, b = _ordinal(lo), _ordinal(hi)
    middle = _double((a >> 1) + (b >> 1) + (a & b & 1))
    for name, p in (("p0", meet), ("p1", by_count), ("p2", middle)):
        s[name] = np.where(np.isfinite(p) & (p > lo) & (p < hi), p, middle)
    return s


def _first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bracket of all scores: the least has all at or above it, so the cutoff is at least that."""
    for s in it:
        n, k = s["n"].to_numpy(float), s["k"].to_numpy(float)
        tau, lo, hi, total = (n - k + 0.5) / n, s["least"].to_numpy(float), s["most"].to_numpy(float), s["total"].to_numpy(float)
        with np.errstate(all="ignore"):
            s["f_lo"], s["f_hi"] = tau * (total - n * lo), (1 - tau) * (n * hi - total)
        s["g_lo"], s["g_hi"] = s["n_least"] * (1 - tau) - tau * (n - s["n_least"]), (1 - tau) * (n - s["n_most"]) - tau * s["n_most"]
        s["lo"], s["hi"], s["ge_lo"], s["ge_hi"] = lo, hi, s["n"], s["n_most"]
        top = s["n_most"] >= s["k"]
        s["cutoff"] = np.where(top, hi, np.where(s["k"] >= s["n"], lo, np.nan))
        s["kept"] = np.where(top, s["n_most"], np.where(s["k"] >= s["n"], s["n"], 0)).astype(np.int64)
        s["by"] = -1
        s = _pivots(s)
        yield s[[x.split()[0] for x in STATE.split(", ")]]


def _next(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shrink each bracket by what the pass counted at its pivots, snapping both ends to scores that occur.

    Always: at lo at least k scores are at or above it, at hi fewer than k (so lo <= cutoff < hi).
    """
    for s in it:
        s = s.copy()
        lo, hi, k, n = (s[x].to_numpy(float).copy() for x in ("lo", "hi", "k", "n"))
        tau = (n - k + 0.5) / n
        state = {x: s[x].to_numpy(float).copy() for x in ("f_lo", "f_hi", "g_lo", "g_hi", "ge_lo", "ge_hi")}
        cutoff, kept = s["cutoff"].to_numpy(float).copy(), s["kept"].to_numpy(np.int64).copy()
        by = s["by"].to_numpy(np.int64).copy()
        for j in range(PIVOTS):
            # counts relative to pivot p: ge (>= p), up (least score >= p), n_up, sum_ge; dn (largest score < p), n_dn, sum_lt
            ge, up, n_up, dn, n_dn, sum_ge, sum_lt = (s[f"{x}{j}"].to_numpy(float) for x in ("ge", "up", "nu", "dn", "nd", "sg", "sl"))
            with np.errstate(all="ignore"):
                enough = ge >= k
                # the cutoff is at or above up: if fewer lie beyond up, it is up itself
                hit = enough & (ge - n_up < k)
                by[hit & np.isnan(cutoff)] = j
                cutoff[hit], kept[hit] = up[hit], ge[hit].astype(np.int64)
                rise = enough & ~hit & (up > lo)
                lo[rise] = up[rise]
                state["ge_lo"][rise] = ge[rise]
                state["f_lo"][rise] = (tau * (sum_ge - ge * up) + (1 - tau) * ((n - ge) * up - sum_lt))[rise]
                state["g_lo"][rise] = ((1 - tau) * (n - ge + n_up) - tau * (ge - n_up))[rise]
                # the cutoff is below p: if enough lie at or above dn, it is dn itself
                low = ~enough & (ge + n_dn >= k)
                by[low & np.isnan(cutoff)] = j
                cutoff[low], kept[low] = dn[low], (ge + n_dn)[low].astype(np.int64)
                fall = ~enough & ~low & (dn < hi)
                hi[fall] = dn[fall]
                state["ge_hi"][fall] = (ge + n_dn)[fall]
                state["f_hi"][fall] = (tau * (sum_ge - ge * dn) + (1 - tau) * ((n - ge) * dn - sum_lt))[fall]
                state["g_hi"][fall] = ((1 - tau) * (n - ge - n_dn) - tau * (ge + n_dn))[fall]
        s["lo"], s["hi"], s["cutoff"], s["kept"], s["by"] = lo, hi, cutoff, kept, by
        for x, v in state.items():
            s[x] = v.astype(np.int64) if x.startswith("ge") else v
        s = _pivots(s)
        yield s[[x.split()[0] for x in STATE.split(", ")]]


@dataclass
class Cutoffs:
    """cutoffs: source, keep_pct, n_counted, cutoff, n_kept. counted: source, id, score, as written once. passes: the pass and pivot that decided each source
    (0 cutting plane, 1 by count, 2 the middle, -1 the ends)."""

    cutoffs: DataFrame
    counted: DataFrame
    passes: DataFrame

    def kept(self) -> DataFrame:
        """(source, id) of all records at or above their source's cutoff."""
        source = self.cutoffs.columns[0]
        return lookup_join(self.counted, self.cutoffs.filter("cutoff is not null").select(c(source), "cutoff"), [source]).filter(c("__score") >= c("cutoff")).drop("__score", "cutoff")


def fraction_cutoffs(records: DataFrame, targets: DataFrame, source: str = "task_index", score: str = "complementary_info.advantage_v1", ident: str = "index", share: str = "keep_pct") -> Cutoffs:
    """Per source the largest score that keeps at least ``share`` percent of its records, and how many that keeps.

    The cutoff is the order statistic that minimises the source's convex pinball loss. Each pass over the counted records
    aggregates, for all sources at once, loss and subgradient at a few pivots; cutting planes give the next ones;
    the ends of the bracket snap to the neighbouring scores, so the result is exact. A pass shuffles
    one row a source and task, however unevenly sources are filled. Sums steer the search only; counts decide.

    Counted: distinct ids with a score that is neither null nor NaN (infinities count) and a source with a target. Repeated
    rows count once; an id under two sources or with two scores counts for each. Ties at the cutoff are all
    kept. A share of 0 or less keeps the ties of the largest score, one above 100 has no cutoff (null, 0 kept), a null share is
    no target; of several shares for a source the largest holds. A source without records has n_counted 0 and cutoff null.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "cutoff")
    t = targets.select(F.col(source).cast("long").alias("s"), F.col(share).cast("double").alias("pct")).filter("s is not null and pct is not null and not isnan(pct)").groupBy("s").agg(F.max("pct").alias("pct"))
    t = ws.save(t, "targets")
    rows = records.select(c(source).cast("long").alias("s"), c(ident).alias("i"), c(score).cast("double").alias("x")).filter("s is not null and i is not null and x is not null and not isnan(x)")
    counted = ws.save(lookup_join(rows, t.select("s"), ["s"], "left_semi").distinct(), "counted")

    # scores with their multiplicity: fewer rows where scores repeat, and the ties at any score in the same pass
    values = ws.save(counted.groupBy("s", "x").agg(F.count(F.lit(1)).alias("m")), "values")
    finite = F.when(F.abs("x") < float("inf"), F.col("x") * F.col("m"))
    ends = values.groupBy("s").agg(F.sum("m").alias("n"), F.min("x").alias("least"), F.min_by("m", "x").alias("n_least"), F.max("x").alias("most"), F.max_by("m", "x").alias("n_most"), F.coalesce(F.sum(finite), F.lit(0.0)).alias("total"))
    sizes = ends.join(t, ["s"]).filter("pct <= 100")
    sizes = sizes.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("pct") / 100)).cast("long"))
    # ceil() of a rounded product can be one off: the smallest k with 100 k >= pct n
    sizes = sizes.withColumn("k", F.when((F.col("k") > 1) & ((F.col("k") - 1) * 100 >= F.col("pct") * F.col("n")), F.col("k") - 1).when(F.col("k") * 100 < F.col("pct") * F.col("n"), F.col("k") + 1).otherwise(F.col("k")))
    state = ws.save(sizes.mapInPandas(_first, STATE), "state")
    done = [state.filter("cutoff is not null")]
    state = state.filter("cutoff is null")
    while state.limit(1).count():
        near = lookup_join(values, state.select("s", "p0", "p1", "p2"), ["s"])
        aggs, cols = [], ["s"]
        for j in range(PIVOTS):
            above, below = F.col("x") >= F.col(f"p{j}"), F.col("x") < F.col(f"p{j}")
            aggs += [F.sum(F.when(above, F.col("m"))).alias(f"ge{j}"), F.min(F.when(above, F.col("x"))).alias(f"up{j}"), F.min_by("m", F.when(above, F.col("x"))).alias(f"nu{j}"), F.max(F.when(below, F.col("x"))).alias(f"dn{j}"), F.max_by("m", F.when(below, F.col("x"))).alias(f"nd{j}"), F.sum(F.when(above, finite)).alias(f"sg{j}"), F.sum(F.when(below, finite)).alias(f"sl{j}")]
            cols += [F.coalesce(f"ge{j}", F.lit(0)).alias(f"ge{j}"), f"up{j}", f"nu{j}", f"dn{j}", f"nd{j}"]
            cols += [F.coalesce(f"sg{j}", F.lit(0.0)).alias(f"sg{j}"), F.coalesce(f"sl{j}", F.lit(0.0)).alias(f"sl{j}")]
        sides = near.groupBy("s").agg(*aggs).select(*cols)
        nxt = ws.save(state.join(sides, ["s"]).mapInPandas(_next, STATE), "state")
        done.append(nxt.filter("cutoff is not null"))
        state = nxt.filter("cutoff is null")
    found = done[0].select("s", "cutoff", "kept", "by", F.lit(0).alias("pass"))
    for k, d in enumerate(done[1:], start=1):
        found = found.unionByName(d.select("s", "cutoff", "kept", "by", F.lit(k).alias("pass")))
    out = t.join(counted.groupBy("s").agg(F.count(F.lit(1)).alias("n_counted")), ["s"], "left").join(found, ["s"], "left")
    out = ws.save(out.select(F.col("s").alias(source), F.col("pct").alias("keep_pct"), F.coalesce("n_counted", F.lit(0)).alias("n_counted"), "cutoff", F.coalesce("kept", F.lit(0)).alias("n_kept")), "cutoffs")
    return Cutoffs(out, counted.select(F.col("s").alias(source), F.col("i").alias(ident), F.col("x").alias("__score")), found.select(F.col("s").alias(source), "pass", "by"))
