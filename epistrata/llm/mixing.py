"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistrata.llm.tokens import DEFAULT_VOCABULARY, tokenizer
from epistrata.runtime import Workspace, lookup_join

#: Cells of the unit interval in which a source's tokens are summed to set its rate.
CELLS = 4096
#: Numbers of copies that are listed at once, so a document repeated any number of times makes no long list.
COPY_BLOCK = 65_536


def normal_source(col: Column) -> Column:
    """Source without letter case and outer blanks; null stays null."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            n = pa.array([tok.count(t) if t else 0 for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*b.schema.names[1:], "n_tokens"])

    return run


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The ``keep`` columns and n_tokens of the whole text; a null or empty text has 0."""
    kept = df.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(_counter(vocabulary), f"{schema}, n_tokens long" if schema else "n_tokens long")


def uniform(seed: int) -> Column:
    """A document's number in [0, 1), from its id (its text where the id is null) and the seed."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), "text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def poisson_steps(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """(base, steps): a document with number u is used base times and once more for every step at or below u, at most cap times.

    The steps are P(N <= k) for k = base, base + 1, …; below base the probability is under 1e-20, beyond the last step it is 1 to the precision
    of a double. So there are about 20 standard deviations of them, however large rate and cap are.
    """
    if cap <= 0 or rate <= 0:
        return 0, np.zeros(0)
    spread = 10 * math.sqrt(rate) + 40
    base = 0 if rate <= spread else int(min(rate - spread, cap))
    n = int(min(cap - base, 2 * spread + 40)) if np.isfinite(rate) else 0
    if not np.isfinite(rate) or n <= 0:
        return cap, np.zeros(0)
    k = np.arange(base + 1, base + n, dtype=float)
    first = base * math.log(rate) - rate - math.lgamma(base + 1)
    logs = first + np.concatenate([[0.0], np.cumsum(math.log(rate) - np.log(k))])
    return base, np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _used(plan: tuple[int, np.ndarray], tokens: np.ndarray) -> float:
    """Tokens used under a plan, the tokens of a cell lying evenly in it."""
    base, steps = plan
    upto = np.concatenate([[0.0], np.cumsum(tokens)])
    at = np.minimum(steps * CELLS, CELLS)
    i = np.minimum(at.astype(int), CELLS - 1)
    return float(base * upto[-1] + np.sum(upto[-1] - (upto[i] + (at - i) * tokens[i])))


def _use() -> Column:
    """How often a document is used."""
    return F.col("base") + F.size(F.filter("steps", lambda x: x <= F.col("u")))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rate of one source at which its use comes to what is wanted, by bisection; its Poisson steps."""
    want, cap = float(pdf["want"].iloc[0]), int(pdf["cap"].iloc[0])
    tokens = np.zeros(CELLS)
    np.add.at(tokens, pdf["cell"].to_numpy(int), pdf["tokens"].to_numpy(float))
    low, high = 0.0, float("inf") if want > 0 else 0.0
    if 0 < want < cap * tokens.sum() * (1 - 1e-9):
        high = 1.0
        while _used(poisson_steps(high, cap), tokens) < want and high < float("inf"):
            high *= 2
        for _ in range(60 if high < float("inf") else 0):
            mid = (low + high) / 2
            low, high = (mid, high) if _used(poisson_steps(mid, cap), tokens) < want else (low, mid)
    base, steps = poisson_steps(high, cap)
    return pd.DataFrame({"src": [pdf["src"].iloc[0]], "rate": [high], "base": [base], "steps": [steps.tolist()]})


@dataclass
class Mix:
    """copies: source, doc_id, copy_no, n_copies, text, shuffle_key in shuffled order; sized: source, tokens of each document."""

    copies: DataFrame
    targets: DataFrame
    sized: DataFrame
    plan: DataFrame

    def shares(self) -> DataFrame:
        """Per target source: target_share, effective_target (after sources that have nothing to give left theirs to the others), max_repeats, documents, tokens, rate, copies, most_repeats, tokens_used, actual_share."""
        drawn = lookup_join(self.sized, self.plan.select("src", "base", "steps"), ["src"], "left").withColumn("n", F.coalesce(_use(), F.lit(0)))
        drawn = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("n").alias("copies"), F.max("n").alias("most"), F.sum(F.col("n_tokens") * F.col("n")).alias("used"))
        whole = drawn.agg(F.sum("used")).first()[0] or 0
        n = lambda name: F.coalesce(name, F.lit(0))
        able = F.col("rate").isNotNull()
        held = self.targets.join(self.plan.select("src"), ["src"]).agg(F.sum("w")).first()[0] or 0.0
        return self.targets.join(drawn, ["src"], "left").join(self.plan.select("src", "rate"), ["src"], "left").select(
            F.col("src").alias("source"), F.col("w").alias("target_share"), F.when(able, F.try_divide(F.col("w"), F.lit(held))).otherwise(0.0).alias("effective_target"), F.col("cap").alias("max_repeats"), n("documents").alias("documents"), n("tokens").alias("tokens"),
            "rate", n("copies").alias("copies"), n("most").alias("most_repeats"), n("used").alias("tokens_used"), F.coalesce(F.try_divide(F.col("used"), F.lit(whole)), F.lit(0.0)).alias("actual_share"),
        )


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = DEFAULT_VOCABULARY) -> Mix:
    """Documents repeated so that each source has its share of all tokens, none more than ``max_repeats`` times.

    A document is used as often as a Poisson variable with its source's rate says, inverted at a number
    hashed from its id and cut at the cap; neither rate nor cap has a ceiling. The rate is set on the source's token sums by cell of that number, not on
    its mean, so the share reached is off only by where single documents lie in their cells: about the size of one document a step, which
    is 2 percent for sources of a few dozen documents and vanishes with their number. ``total_tokens`` is the size wanted;
    by default the largest at which every source that has tokens can reach its share within its cap. A larger
    one leaves capped sources short, which ``shares`` shows. The copies are spread over partitions and sorted within them by a
    hash of id, copy and seed: a global shuffle.

    Sources match without case and outer blanks. Documents with a null or unlisted source are not used. Empty and null texts have
    no tokens but are repeated like others of their source. Each row is a document, so repeated rows count as
    several with the same fate. A target null, NaN or at most 0, or a cap null or below 1, uses none of the source; of several rows
    for a source the largest share and cap hold. Empty tables give empty copies. Other columns are not read.
    """
    ws = Workspace(documents.sparkSession, "mix")
    t = targets.select(normal_source(F.col("source")).alias("src"), F.col("target_share").cast("double").alias("w"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("cap")).filter("src is not null")
    t = ws.save(t.withColumn("w", F.when(F.isnan("w") | (F.col("w") <= 0) | F.col("w").isNull(), 0.0).otherwise(F.col("w"))).groupBy("src").agg(F.max("w").alias("w"), F.greatest(F.max("cap"), F.lit(0)).alias("cap")), "targets")
    docs = documents.select(normal_source(F.col("source")).alias("src"), uniform(seed).alias("u"), "doc_id", "text")
    listed = lookup_join(docs, t.select("src"), ["src"], "left_semi")
    sized = ws.save(count_tokens(listed, keep=("src", "u"), vocabulary=vocabulary), "sized")
    cell = F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = ws.save(sized.groupBy("src", cell.alias("cell")).agg(F.sum("n_tokens").alias("tokens")), "cells")
    have = cells.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    able = t.join(have, ["src"]).filter("w > 0 and cap > 0 and tokens > 0")
    row = able.agg(F.min(F.col("cap") * F.col("tokens") / F.col("w")).alias("t"), F.sum("w").alias("w")).first()
    # shares are among the sources that have tokens: the whole is what they can make together
    total = 0.0 if row["t"] is None else (float(total_tokens) / row["w"] if total_tokens is not None else row["t"])
    wanted = able.select("src", (F.col("w") * F.lit(total)).alias("want"), "cap")
    plan = ws.save(lookup_join(cells, wanted, ["src"]).groupBy("src").applyInPandas(_plan, "src string, rate double, base long, steps array<double>"), "plan")
    copies = lookup_join(docs, plan.select("src", "base", "steps"), ["src"]).withColumn("n_copies", _use()).filter("n_copies > 0")
    blocks = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1, F.lit(COPY_BLOCK))))
    copies = blocks.select(F.col("src").alias("source"), "doc_id", F.explode(F.sequence(F.col("block") + 1, F.least("n_copies", F.col("block") + COPY_BLOCK))).alias("copy_no"), "n_copies", "text")
    copies = copies.withColumn("shuffle_key", F.xxhash64("doc_id", "copy_no", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(seed + 1)))
    copies = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return Mix(copies, t, sized, plan)
