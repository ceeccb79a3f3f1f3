"""Splits that keep related records together.

Records tied by an equal id or by a source link form groups; a group never crosses a split. The groups come
from a minimum spanning forest found by Boruvka contraction, the splits from dealing the forest's roots.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epistrata.runtime import HOT_ROWS, Workspace, c, hot_join

#: What people type for a missing id, after normal_id().
MISSING_WORDS = ["", "na", "n/a", "n.a.", "n.a", "nan", "nil", "null", "none", "unknown", "unk", "undefined", "missing", "tbd", "tba", "n-a", "not-known", "not-available", "not-set", "no-id", "?", "??", ".", "/", "\\", "*", "x"]
#: A band with more roots than this is cut at hash prefixes of PREFIX_BITS bits, of which there are as many; a smaller one at its roots.
BAND_CUTS = 4096
PREFIX_BITS = 12


def normal_id(col: Column) -> Column:
    """Id without letter case, outer blanks and kind of separator; null where it is missing or a word for missing."""
    s = F.regexp_replace(F.lower(col.cast("string")), r"^[\s 　]+|[\s 　]+$", "")
    s = F.translate(s, "_ ", "--")
    return F.when(~s.isin(MISSING_WORDS) & ~s.rlike(r"^-*$"), s)


@dataclass
class Forest:
    """groups: key, root, group (the smallest key tied to it). edges: u, v, kind, round of the spanning forest."""

    groups: DataFrame
    edges: DataFrame


def tie_edges(ws: Workspace, records: DataFrame, key: str, ids: list[str], source: str | None) -> tuple[DataFrame, DataFrame]:
    """Vertices and tie edges (u < v, kind). Equal ids give a star around the smallest record, not all pairs."""
    vertices = ws.save(records.select(c(key).alias("v")).filter("v is not null").distinct(), "vertices")
    known = records.select(c(key)).count()
    parts = []
    for kind, name in enumerate(ids, start=1):
        keyed = records.select(c(key).alias("v"), normal_id(c(name)).alias("id")).filter("v is not null and id is not null").distinct()
        hubs = keyed.groupBy("id").agg(F.min("v").alias("u"))
        parts.append(hot_join(keyed, hubs, ["id"], left_rows=known).filter("u != v").select("u", "v", F.lit(kind).alias("kind")))
    if source:
        linked = records.select(c(key).alias("w"), c(source).alias("v")).filter("w is not null and v is not null and w != v").distinct()
        parts.append(hot_join(linked, vertices, ["v"], left_rows=known).select(F.least("w", "v").alias("u"), F.greatest("w", "v").alias("v"), F.lit(0).alias("kind")))
    edges = reduce(DataFrame.unionByName, parts) if parts else vertices.select(F.col("v").alias("u"), "v", F.lit(0).alias("kind")).limit(0)
    return vertices, edges.groupBy("u", "v").agg(F.min("kind").alias("kind"))


def spanning_forest(records: DataFrame, key: str = "episode_index", ids: tuple[str, ...] = ("operator_id", "scene_id"), source: str | None = "source_episode_index", seed: int = 7) -> Forest:
    """Groups of records tied by ids or source, with the forest that ties them.

    Every edge gets a weight of its own, a seeded one-to-one hash of its number, so minima are of single longs and chains stay short.
    Every round each component picks its least edge, the picked edges are contracted by pointer jumping (two jumps a
    job), and edges inside a component and parallel edges go. Components at least halve a round. All tables of a round are written to the shared folder.

    Nulls: a record without key is left out; a null, empty or unknown id and a source that is not a record tie
    nothing. Repeated rows count once; if they differ in ids, all their ids tie. Empty input gives empty tables.
    Only the named columns are read, so extra columns with any name do no harm.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "forest")
    vertices, found = tie_edges(ws, records, key, list(ids), source)
    # numbers are written once, so they stay; a hash of one long is one-to-one, so no two edges weigh the same
    ties = ws.save(found.withColumn("w", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))), "ties")
    cur, left = ties.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w"), ties.count()
    jumps: list[DataFrame] = []
    picked: list[DataFrame] = []
    while left:
        half = cur.select(F.col("cu").alias("c"), F.col("cv").alias("o"), "w").union(cur.select(F.col("cv").alias("c"), F.col("cu").alias("o"), "w"))
        best = half.groupBy("c").agg(F.min("w").alias("w"), F.min_by("o", "w").alias("o"))
        # an edge picked from both ends closes the only kind of cycle there is; its smaller end becomes a root
        chosen = ws.save(best.groupBy("w").agg(F.min("c").alias("a"), F.max("c").alias("z"), F.min("o").alias("o"), F.count(F.lit(1)).alias("n")), "chosen")
        picked.append(chosen.select("w", F.lit(len(jumps) + 1).alias("round")))
        both, once = chosen.filter("n = 2"), chosen.filter("n = 1")
        ptr = both.select(F.col("z").alias("c"), F.col("a").alias("p")).union(both.select(F.col("a").alias("c"), F.col("a").alias("p"))).union(once.select(F.col("a").alias("c"), F.col("o").alias("p")))
        n, moved, before = 2 * left, 1, None
        while moved:
            step = ptr.select(F.col("c").alias("p"), F.col("p").alias("q"))
            two = hot_join(ptr, step, ["p"], left_rows=n).select("c", "p", "q")
            three = hot_join(two.select("c", F.col("p").alias("from"), F.col("q").alias("p")), step, ["p"], left_rows=n)
            nxt = ws.save(three.select("c", F.col("q").alias("p"), (F.col("from") != F.col("q")).alias("moved")), "jump")
            row = nxt.agg(F.count(F.lit(1)), F.count_if("moved")).first()
            n, moved = row[0], row[1]
            if before is not None:
                ws.drop(before)
            before, ptr = nxt, nxt.select("c", "p")
        jumps.append(ptr)
        a = hot_join(cur, ptr.select(F.col("c").alias("cu"), F.col("p").alias("nu")), ["cu"], left_rows=left)
        b = hot_join(a, ptr.select(F.col("c").alias("cv"), F.col("p").alias("nv")), ["cv"], left_rows=left).filter("nu != nv")
        cur = ws.save(b.groupBy(F.least("nu", "nv").alias("cu"), F.greatest("nu", "nv").alias("cv")).agg(F.min("w").alias("w")), "edges")
        left = cur.count()
    kind = vertices.schema["v"].dataType
    if jumps:
        to_root = jumps[-1]
        for step in reversed(jumps[:-1]):  # from the smallest table back, so the work is that of the first round twice
            last = to_root.select(F.col("c").alias("p"), F.col("p").alias("r"))
            to_root = hot_join(step, last, ["p"], "left", left_rows=None if n >= HOT_ROWS else n).select("c", F.coalesce("r", "p").alias("p"))
        rooted = ws.save(vertices.join(to_root.select(F.col("c").alias("v"), F.col("p").alias("r")), ["v"], "left").select("v", F.coalesce("r", "v").alias("root")), "rooted")
        smallest = rooted.groupBy("root").agg(F.min("v").alias("group"))
        groups = hot_join(rooted, smallest, ["root"])
        edges = ties.join(reduce(DataFrame.unionByName, picked), ["w"]).select("u", "v", "kind", "round")
    else:
        groups = vertices.select("v", F.col("v").alias("root"), F.col("v").alias("group"))
        edges = spark.createDataFrame([], T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("kind", T.IntegerType()), T.StructField("round", T.IntegerType())]))
    return Forest(ws.save(groups.select(F.col("v").alias(key), "root", "group"), "groups"), edges)


def place_hash(col: Column, seed: int) -> Column:
    """Where a root stands in its band: the first 13 hexadecimal digits of a seeded MD5 as a number below 2^52."""
    return F.conv(F.substring(F.md5(F.concat(col.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")


def band_shares(lack: np.ndarray, roots: int) -> np.ndarray:
    """The parts of a band that splits get: in proportion to what they lack; a split due less than half a root gets none, unless all are."""
    short = np.maximum(lack, 0.0)
    if short.sum() <= 0:
        short = np.ones(lack.size)
    due = short / short.sum()
    kept = np.where(due * roots >= 0.5, due, 0.0)
    if kept.sum() <= 0:
        kept = np.where(np.arange(lack.size) == np.argmax(due), 1.0, 0.0)
    return kept / kept.sum()


def deal_splits(groups: DataFrame, targets: DataFrame, key: str = "episode_index", seed: int = 7, weights: DataFrame | None = None) -> DataFrame:
    """(key, group, split_name): every group dealt whole to one split, shares of the records near ``fraction``.

    Roots are stratified by size band (powers of two) and stand in their band in the order of a seeded hash. A band is dealt systematically: laid
    end to end its roots are cut into one stretch a split, as long as the split's part of the band, and a root belongs to the stretch that
    holds its middle. Bands go from the largest roots down, and a split's part of a band is in proportion to what it lacks after the
    bands before, so what large roots leave uneven smaller ones fill up. This holds at every size; only where cuts may lie
    differs: in a band of up to BAND_CUTS roots between any two, in a larger one between hash prefixes, 1/BAND_CUTS of it apart.
    The driver gets one row a cut and band (at most 64 x BAND_CUTS); roots are dealt by comparing their hash with the cuts.

    ``weights`` (key, weight) balances the sum of weights, such as frames, instead of the number of records; a record without a weight, or with one null, NaN or below 0, weighs 0.
    Fractions are taken relative to their sum; null, NaN and negative ones count as 0, repeated names once (the
    largest). Without a positive fraction, split_name is null. Targets are a table of settings, read whole. Empty groups give an empty result.
    """
    spark = groups.sparkSession
    ws = Workspace(spark, "deal")
    rows = targets.select(F.col("split_name"), F.when(~F.isnan("fraction") & (F.col("fraction") > 0), F.col("fraction").cast("double")).otherwise(0.0).alias("f")).groupBy("split_name").agg(F.max("f").alias("f")).filter("f > 0 and split_name is not null").orderBy(F.desc("f"), "split_name").collect()
    if not rows:
        return groups.select(c(key), "group", F.lit(None).cast("string").alias("split_name"))
    heavy = groups.select(c(key).alias("k"), "group")
    if weights is None:
        heavy = heavy.withColumn("x", F.lit(1.0))
    else:
        told = weights.select(c(key).alias("k"), F.col("weight").cast("double").alias("x")).filter("x > 0 and not isnan(x)").groupBy("k").agg(F.max("x").alias("x"))
        heavy = heavy.join(told, ["k"], "left").na.fill(0.0, ["x"])
    sizes = heavy.groupBy("group").agg(F.sum("x").alias("n"))
    sizes = ws.save(sizes.select("group", "n", F.greatest(F.lit(0), F.floor(F.log2(F.greatest("n", F.lit(1.0)))).cast("int")).alias("band"), place_hash(F.col("group"), seed).alias("h")), "sizes")
    small = {r["band"]: r["count"] for r in sizes.groupBy("band").count().collect()}
    exact = F.col("band").isin([b for b, n in small.items() if n <= BAND_CUTS])
    spot = F.when(exact, F.col("h")).otherwise(F.shiftleft(F.shiftright("h", 52 - PREFIX_BITS), 52 - PREFIX_BITS))
    laid = sizes.groupBy("band", spot.alias("spot")).agg(F.sum("n").alias("n")).orderBy(F.desc("band"), "spot").toPandas()  # at most BAND_CUTS rows a band
    names = [r["split_name"] for r in rows]
    fraction = np.array([r["f"] for r in rows])
    lack = fraction / fraction.sum() * float(laid["n"].sum())
    cuts = []
    for band, at in laid.groupby("band", sort=False):
        n = at["n"].to_numpy(float)
        share = band_shares(lack, small[band])
        ends = np.cumsum(share) * n.sum()
        ends[np.flatnonzero(share)[-1] :] = np.inf
        to = np.searchsorted(ends, np.cumsum(n) - n / 2, "right")
        lack = lack - np.bincount(to, n, len(names))
        spots = at["spot"].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        cuts += [(int(band), int(spots[i]) if i else 0, names[to[i]]) for i in first]
    ranges = spark.createDataFrame(cuts, "band int, low long, split_name string")
    by_band = F.broadcast(ranges.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("low", "split_name"))).alias("cuts")))  # one row a band
    last = F.element_at(F.filter("cuts", lambda x: x["low"] <= F.col("h")), -1)["split_name"]
    named = ws.save(sizes.join(by_band, ["band"]).select("group", last.alias("split_name")), "named")
    return hot_join(groups.select(c(key), "group"), named, ["group"]).select(c(key), "group", "split_name")


def split_report(splits: DataFrame, frames: DataFrame, targets: DataFrame, key: str = "episode_index", index: str = "index") -> DataFrame:
    """Per split: target, records, frames (distinct ``index``) and the shares reached; frames of unknown episodes have split_name null."""
    per = frames.select(c(key).alias("k"), c(index).alias("i")).filter("i is not null").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    s = splits.select(c(key).alias("k"), "split_name", F.lit(1).alias("one"))
    both = s.join(per, ["k"], "full_outer").groupBy("split_name").agg(F.coalesce(F.sum("one"), F.lit(0)).alias("episodes"), F.coalesce(F.sum("m"), F.lit(0)).alias("frames"))
    t = targets.filter("split_name is not null").groupBy("split_name").agg(F.max("fraction").alias("target"))
    w = Window.partitionBy()  # one row a split
    return (
        t.join(both, ["split_name"], "full_outer").na.fill(0, ["episodes", "frames"])
        .select("split_name", "target", "episodes", "frames", F.try_divide("episodes", F.sum("episodes").over(w)).alias("episode_share"), F.try_divide("frames", F.sum("frames").over(w)).alias("frame_share"))
    )


def frames_with_split(frames: DataFrame, splits: DataFrame, key: str = "episode_index") -> DataFrame:
    """(key, index, split_name) of every distinct frame; null where its episode is unknown."""
    f = frames.select(c(key), "index").distinct()
    return hot_join(f, splits.select(c(key), "split_name"), [key], "left").select(c(key), "index", "split_name")
