"""The test tables as clean trajectory views, in Spark and as SQL. A frame row that was sent again counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.runtime import c


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_frames(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Frames with their repeats. Columns: index, episode_index, and those asked for (all if none) of frame_index, timestamp (double), task_index, action, state, advantage, intervention, collector."""
    names = {"timestamp": F.col("timestamp").cast("double"), "state": c("observation.state"), "advantage": c("complementary_info.advantage_v1").cast("double"), "intervention": c("complementary_info.is_intervention").cast("double"), "collector": c("complementary_info.collector_policy_id")}
    keep = [k for k in ("frame_index", "timestamp", "task_index", "action", "state", "advantage", "intervention", "collector") if k in columns or not columns]
    return table(spark, sf, "frames").select("index", "episode_index", *[names.get(k, F.col(k)).alias(k) for k in keep])


def frames(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Frames without repeats, by one shuffle that spreads every episode; a window by episode, or by stretches of one, shuffles anew."""
    return raw_frames(spark, sf, *columns).repartition("episode_index", "index").dropDuplicates(["episode_index", "index"])


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes without repeats, with success as true, false or null."""
    df = table(spark, sf, "episodes").drop("ingested_at").dropDuplicates(["episode_index"])
    return df.withColumn("label", F.lower(F.trim("episode_success")))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tasks")


#: Common table expressions of the same views.
FR = """fr as (select distinct "index" as i, episode_index as ep, frame_index as fi, timestamp::double as ts, task_index as task, action, "observation.state" as state,
  "complementary_info.advantage_v1"::double as adv, "complementary_info.is_intervention"::double as iv, "complementary_info.collector_policy_id" as collector from frames)"""
EP = """eps as (select distinct episode_index as ep, tasks, length, dataset_from_index as f0, dataset_to_index as f1, lower(trim(episode_success)) as label, episode_success, repo_id, robot_type, fps, operator_id, recorded_at,
  "data/chunk_index" as chunk, "data/file_index" as file from episodes)"""
EV = """ev as (select event_id, user_id, ts, event_type, value, props, row_number() over (partition by user_id order by ts, event_id) - 1 as fi from events)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
