"""Trimming over all episodes, and over some by the operator's own parameter."""

from epistrata.operators import windows
from epistrata.plans import register, window_queries  # noqa: F401
from tests import sqlcheck


def test_every_episode_is_trimmed(spark):
    f = spark.read.parquet(f"{sqlcheck.SF}/frames.parquet").select("index", "episode_index").distinct()
    odd = {r["index"] for r in f.filter("episode_index % 2 = 1").collect()}
    got = {r["index"] for r in register.QUERIES["seq_sampler_all"](spark, sqlcheck.SF).collect()}
    assert got & odd and got - odd


def test_some_episodes_by_parameter(spark):
    df = spark.createDataFrame([(10 * e + k, e, k) for e in range(3) for k in range(5)], "index long, episode_index long, frame_index long")
    assert sorted(r["index"] for r in windows.trimmed_frames(df, 2, 1, [0, 2]).collect()) == [2, 3, 22, 23]
    assert sorted(r["index"] for r in windows.trimmed_frames(df, 2, 1).collect()) == [2, 3, 12, 13, 22, 23]
