"""Queries over the test tables, by problem. Those that SQL can express have their twin in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.llm import chunking, cutoff, leakage, mixing, nearest_time, splits

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.spanning_forest(_t(spark, sf, "episodes")).groups.select("episode_index", F.col("group").alias("group_episode_index"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.spanning_forest(_t(spark, sf, "episodes")).groups
    return splits.deal_splits(groups, _t(spark, sf, "split_targets"))


def p1_forest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.spanning_forest(_t(spark, sf, "episodes")).edges


def p1_forest_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes and forest edges of each group: a tree has one edge fewer than records, and its edges stay inside."""
    f = splits.spanning_forest(_t(spark, sf, "episodes"))
    inside = f.edges.join(f.groups.select(F.col("episode_index").alias("u"), F.col("group").alias("gu")), ["u"]).join(f.groups.select(F.col("episode_index").alias("v"), F.col("group").alias("gv")), ["v"])
    edges = inside.filter("gu = gv").groupBy(F.col("gu").alias("group")).agg(F.count(F.lit(1)).alias("edges"))
    return f.groups.groupBy("group").agg(F.count(F.lit(1)).alias("episodes")).join(edges, ["group"], "left").na.fill(0, ["edges"])


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(p1_splits(spark, sf), _t(spark, sf, "frames"), _t(spark, sf, "split_targets"))


def p1_frames(spark: SparkSession, sf: str) -> DataFrame:
    return splits.frames_with_split(_t(spark, sf, "frames"), p1_splits(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_time.match_nearest(_t(spark, sf, "sensor_samples"), _t(spark, sf, "frames"), _t(spark, sf, "sync_configs")).select("sample_id", "index")


def p2_all(spark: SparkSession, sf: str) -> DataFrame:
    out = nearest_time.match_nearest(_t(spark, sf, "sensor_samples"), _t(spark, sf, "frames"), _t(spark, sf, "sync_configs"), keep_unmatched=True)
    return out.select("sample_id", "index", F.round("dt", 6).alias("dt"))


def _cutoffs(spark: SparkSession, sf: str) -> cutoff.Cutoffs:
    return cutoff.fraction_cutoffs(_t(spark, sf, "frames"), _t(spark, sf, "keep_targets"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cutoffs(spark, sf).kept().select("task_index", "index")


def p3_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return _cutoffs(spark, sf).cutoffs


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    leaks = leakage.leaked_passages(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"), tile=leakage.MIN_RUN, coverage=None)
    return leaks.select("doc_id", "item_id")


def p6_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_passages(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(p6_tiles(spark, sf), _t(spark, sf, "eval_items"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p7_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).copies


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).shares()


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_oversized(_t(spark, sf, "documents"), _t(spark, sf, "chunk_limits"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_splits, p1_forest, p1_forest_sizes, p1_report, p1_frames, p2_found, p2_all, p3_found, p3_cutoffs, p6_found, p6_tiles, p6_items, p7_mixed, p7_shares, p8_pieces)}
