"""The four named merge functions give four different values."""

from epistrata.plans import register, stream_queries  # noqa: F401
from tests import sqlcheck


def test_every_function_is_evaluated_on_every_frame(spark):
    rows = register.QUERIES["udf_agg_fn"](spark, sqlcheck.SF).toPandas()
    n = rows.groupby("name").size()
    frames = spark.read.parquet(f"{sqlcheck.SF}/frames.parquet").select("episode_index", "index").distinct().count()
    assert n.to_dict() == dict.fromkeys(("weighted_average", "latest_only", "average", "conservative"), frames)
    x = rows.pivot(index=["robot", "timestep"], columns="name", values="x")
    assert (abs(x["average"] - (x["weighted_average"] + x["conservative"]) / 2) < 2e-5).all() and (x["latest_only"] != x["average"]).any()
