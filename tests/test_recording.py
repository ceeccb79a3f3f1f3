"""Recording in batches, saved with ids and statistics."""

import pytest
from pyspark.sql import functions as F

from epistrata.sources import dataset

ROWS = [(3, 0, "b", [1.0, None]), (3, 1, "b", [2.0, 5.0]), (3, 2, "new", [3.0, 7.0]), (3, 3, None, [4.0, None]), (8, 4, "a", [0.0, 1.0]), (8, 5, "a", [2.0, 1.0])]


def batch(spark, seqs):
    return spark.createDataFrame([r for r in ROWS if r[1] in seqs], "episode_index long, seq long, task string, action array<float>")


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    rec = dataset.Recorder(str(tmp_path_factory.mktemp("rec")), 10.0)
    for number, seqs in [(0, (0, 4)), (1, (1, 2)), (1, (1, 2)), (2, (3, 5)), (0, (0, 4))]:  # 0 and 1 are sent again
        rec.write_batch(batch(spark, seqs), number)
    rec.save(spark, {"action": {"dtype": "float32", "shape": (2,)}}, spark.createDataFrame([("a", 0), ("b", 7)], "task string, task_index long"))
    return rec


def test_an_episode_counts_on_over_batches(spark, recorded):
    got = dataset.scan_frames(spark, recorded.root).orderBy("seq").collect()
    assert [(r.seq, r.episode_index, r.frame_index, r["index"], round(r.timestamp, 6), r.task_index) for r in got] == [(0, 0, 0, 0, 0.0, 7), (1, 0, 1, 1, 0.1, 7), (2, 0, 2, 2, 0.2, 8), (3, 0, 3, 3, 0.3, None), (4, 1, 0, 4, 0.0, 0), (5, 1, 1, 5, 0.1, 0)]


def test_ids_and_statistics_are_saved(spark, recorded):
    e = dataset.scan_episodes(spark, recorded.root, stats=True).orderBy("episode_index").collect()
    assert [(r.length, r.dataset_from_index, r.dataset_to_index, r.tasks) for r in e] == [(4, 0, 4, ["b", "new"]), (2, 4, 6, ["a"])]
    assert [(list(r["stats/action/mean"]), list(r["stats/action/count"])) for r in e] == [([2.5, 6.0], [4, 2]), ([1.0, 1.0], [2, 2])]
    s = {(r.stat, r.dim): r.value for r in dataset.scan_stats(spark, recorded.root).collect()}
    assert (s["mean", 0], s["count", 0], s["max", 1], s["count", 1]) == (2.0, 6, 7.0, 4)
    info = dataset.scan_info(spark, recorded.root)
    assert (info["total_episodes"], info["total_frames"], info["total_tasks"]) == (2, 6, 3)


def test_more_batches_and_another_save_keep_task_ids(spark, recorded):
    recorded.write_batch(batch(spark, (3,)).withColumn("task", F.lit("aa")).withColumn("seq", F.lit(9).cast("long")), 3)
    recorded.save(spark, {"action": {"dtype": "float32", "shape": (2,)}})
    got = {r.seq: r for r in dataset.scan_frames(spark, recorded.root).collect()}
    assert (got[9].frame_index, got[9]["index"], got[9].task_index) == (4, 4, 9) and (got[2].task_index, got[5]["index"]) == (8, 6)


def test_ids_of_nested_steps_are_exact(spark):
    df = spark.sql("select 1L as episode_index, array(named_struct('index', 16777217L, 'a', array(1.0f)), named_struct('index', 16777219L, 'a', array(2.0f))) as steps")
    got = dataset.nested_episodes_to_frames(df, "steps", {"v": ["a", "a"]}, [], ["index"]).orderBy("frame_index").collect()
    assert [(r.frame_index, r["index"], r.v) for r in got] == [(0, 16777217, [1.0, 1.0]), (1, 16777219, [2.0, 2.0])]
