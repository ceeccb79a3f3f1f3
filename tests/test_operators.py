"""Hand-computed cases of the reference's operators, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrata.functions import arrays, text
from epistrata.operators import advantage, episodes, joins, metrics, stats, windows
from epistrata.plans import pipeline
from epistrata.sources import dataset
from epistrata.streaming import queues

FRAMES = "index long, episode_index long, frame_index long"


def col(df, name):
    return [r[name] for r in df.orderBy("index").collect()]


def close(a, b):
    return np.allclose(a, b, atol=1e-6)


# --- advantages ---


@pytest.fixture()
def five(spark):
    return spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1)], FRAMES)


def test_value_targets(spark, five):
    e = spark.createDataFrame([(0, ["t"], 3, True), (1, ["t"], 2, False)], "episode_index long, tasks array<string>, length long, success boolean")
    assert close(col(advantage.value_targets(five, e), "target"), [-2 / 6, -1 / 6, 0, -4 / 6, -3 / 6])
    with pytest.raises(Exception, match="no episode"):
        advantage.value_targets(five, e.filter("episode_index = 0")).collect()


def test_dense_rewards(spark, five):
    g = spark.createDataFrame([(0, -0.6), (1, -0.4), (2, -0.2), (3, -0.8), (4, -0.5)], "index long, target double")
    assert close(col(advantage.dense_rewards(advantage.runs(five.join(g, ["index"]))), "reward"), [-0.2, -0.2, -0.2, -0.3, -0.5])


def test_a_gap_ends_a_run(spark):
    df = spark.createDataFrame([(0, 0, 0, -0.5), (1, 0, 1, -0.4), (2, 0, 5, -0.1)], FRAMES + ", target double")
    assert close(col(advantage.dense_rewards(advantage.runs(df)), "reward"), [-0.1, -0.4, -0.1])


def test_n_step(spark):
    df = spark.createDataFrame([(k, 0, k, -0.2, v) for k, v in enumerate([-0.5, -0.3, -0.1])], FRAMES + ", reward double, value double")
    assert close(col(advantage.n_step_advantages(advantage.runs(df), 2), "advantage"), [0, -0.1, -0.1])


def test_threshold_and_indicator(spark):
    df = spark.createDataFrame([(k, t, a, i) for k, (t, a, i) in enumerate([(0, -0.4, 0.0), (0, -0.1, 1.0), (0, 0.3, 0.0), (1, -0.2, 0.0), (1, 0.2, 0.0)])], "index long, task_index long, advantage double, intervention double")
    assert col(advantage.indicators(df, advantage.task_thresholds(df, 0.5)), "indicator") == [0, 1, 1, 0, 1]


def test_stretches_give_what_episodes_give(spark, monkeypatch):
    rows = [(e * 1000 + k, e, f, -((k * 37 % 11) / 11.0)) for e, n in ((0, 200), (1, 3)) for k, f in enumerate(x for x in range(n) if x % 53 != 7)]
    f = spark.createDataFrame(rows + rows[:9], FRAMES + ", value double")
    e = spark.createDataFrame([(0, ["t"], 200, True), (1, ["t"], 3, False)], "episode_index long, tasks array<string>, length long, success boolean")
    whole = {r["index"]: (r.target, r.reward, r.advantage) for r in advantage.advantages(f, e, 7).collect()}
    monkeypatch.setattr(advantage.in_parts, "__defaults__", (16,))
    split = advantage.advantages(f, e, 7).collect()
    assert len(split) == len(rows) == len(whole)
    assert all(close((r.target, r.reward, r.advantage), whole[r["index"]]) for r in split)


# --- statistics ---


def test_merge(spark):
    s = "feature string, dim int, mean double, std double, count long, min double, max double"
    r = stats.merge_stats(spark.createDataFrame([("a", 0, 5.0, 2.0, 1, 1.0, 10.0), ("a", 0, 6.0, 2.5, 1, 2.0, 12.0)], s)).first()
    assert close([r["mean"], r["std"], r["min"], r["max"], r["count"]], [5.5, 2.318405, 1, 12, 2])
    out = {x.feature: x for x in stats.merge_stats(spark.createDataFrame([("s", 0, 5.5, 2.87, 10, 0.0, 1.0), ("s", 0, 8.5, 3.42, 15, 0.0, 1.0), ("extra", 0, 1.0, 0.5, 3, 0.0, 2.0)], s)).collect()}
    assert abs(out["s"]["mean"] - 7.3) < 1e-9 and abs(out["s"]["std"] - 3.5317) < 1e-4 and close([out["extra"]["mean"], out["extra"]["std"]], [1.0, 0.5])


def test_length_histogram(spark):
    one = stats.length_histogram(spark.range(1, 101).withColumnRenamed("id", "length")).orderBy("bin").collect()
    assert len(one) == 20 and sum(r.n for r in one) == 100
    same = stats.length_histogram(spark.createDataFrame([(42,)] * 4, "length int")).collect()
    assert len(same) == 20 and [r.n for r in same if r.n] == [4]


def test_temporal_shares(spark):
    s = spark.createDataFrame([("A", "reach", 0, 80), ("A", "lift", 80, 100), ("B", "reach", 0, 40), ("B", "lift", 40, 200)], "episode_index string, segment string, start int, end int")
    assert {r.segment: round(r.share, 9) for r in metrics.temporal_shares(s).collect()} == {"reach": 0.5, "lift": 0.5}


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = stats.feature_stats(df, ["x"]).first()
    assert (r["count"], r["mean"], r["q50"]) == (2, 2.0, 2.0)
    assert stats.feature_stats(df.limit(0), ["x"]).count() == 0


# --- numbers ---


def test_two_hot(spark):
    for x, want in ((-1.0, (0, 1.0, 0, 0.0)), (-0.5, (1, 1.0, 1, 0.0)), (-0.25, (1, 0.5, 2, 0.5)), (0.0, (2, 1.0, 2, 0.0))):
        assert tuple(spark.range(1).select(arrays.two_hot(F.lit(x), 3, -1.0, 0.0).alias("t")).first().t) == want


def test_expected_value(spark):
    e = lambda *x: spark.range(1).select(arrays.expected_value(F.array(*[F.lit(float(k)) for k in x]), -1.0, 0.0).alias("v")).first().v
    assert close(e(100, -100, -100), -1) and close(e(-100, -100, 100), 0)


def test_digitize_edges(spark):
    xs = [-1.5, -1.0, -0.9999, 0.0, 0.9999, 1.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(arrays.digitize(F.col("x"))).collect()]
    edges = np.linspace(-1.0, 1.0, 257, dtype=np.float32)[:-1]
    assert got == (np.digitize(np.array(xs, np.float32), edges) - 1).tolist()


def test_rotations_go_round(spark):
    v = F.array(*[F.lit(x) for x in (0.3, -1.1, 0.7)])
    q = arrays.rotvec_to_quat(v)
    got = spark.range(1).select(arrays.quat_to_rotvec(arrays.matrix_to_quat(arrays.quat_to_matrix(q))).alias("a"), arrays.quat_apply(q, arrays.quat_apply(arrays.quat_inverse(q), v)).alias("b"), arrays.quat_to_axis_angle(q).alias("c")).first()
    assert close(got.a, [0.3, -1.1, 0.7]) and close(got.b, [0.3, -1.1, 0.7]) and close(got.c, [0.3, -1.1, 0.7])
    zero = spark.range(1).select(arrays.quat_to_axis_angle(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).alias("z")).first().z
    assert zero == [0.0, 0.0, 0.0]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.advantage_tag(F.lit(""), F.lit(True))) == "Advantage: positive" and one(text.seconds_of(F.lit("02:05"))) == 125 and one(text.clock_of(F.lit(125.9))) == "02:05"
    assert one(text.big_number(F.lit(1234))) == "1K" and one(text.outcome(F.lit(" S "))) == "success" and one(text.repaired_json(F.lit("no json"))) is None
    with pytest.raises(Exception, match="0 or 1"):
        one(text.tagged_or_dropped(F.lit("t"), F.lit(2), F.lit(1), 0.0, 1))


# --- windows ---


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_debounce_has_no_short_runs_but_at_a_whole(least):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 60):
        s = rng.random(n) > 0.5
        out = windows.debounced(s, least)
        assert out.size == n and windows.debounced(out, least).tolist() == out.tolist()
        edges = np.flatnonzero(np.diff(out.astype(int)))
        runs = np.diff(np.concatenate([[-1], edges, [n - 1]]))
        assert n == 0 or edges.size == 0 or runs.min() >= least


def test_batch_and_stream_windows_differ_at_the_edge(spark):
    df = spark.createDataFrame([(k, 0, k) for k in range(20)], FRAMES).withColumn("x", F.col("index"))
    batch, stream = windows.offset_window(df, "x", [-10]), windows.stream_offset_window(df, "x", [-10])
    assert batch.filter("index = 5").first().x_window == [0] and stream.filter("index = 5").first().x_window == [5]
    assert batch.filter("index = 5").first().x_is_pad == [True]


def test_stretches_of_an_episode_give_what_the_episode_gives(spark):
    rows = [(e * 1000 + f, e, f, [float(f * f % 17)]) for e, n in ((0, 130), (1, 4), (2, 31)) for f in range(n) if f % 19 not in (3, 4)]
    df = spark.createDataFrame(rows + [(9999, 3, None, [1.0])], FRAMES + ", x array<double>")
    cut = windows.in_stretches(df, 5, 4, 16)
    assert cut.filter("not halo").count() == df.count() and cut.select("episode_index", "stretch").distinct().count() > 10
    runs = {
        "offset": lambda d: windows.offset_window(d, "x", [-5, -1, 0, 4]), "stream": lambda d: windows.stream_offset_window(d, "x", [-5, -1, 0, 4]), "chunks": lambda d: windows.action_chunks(d, 4, "x"),
        "next": lambda d: windows.next_states(d, "x").drop("done"), "velocity": lambda d: windows.joint_velocity(d, 0.1, 1, "x"),
    }
    for name, run in runs.items():
        want, got = run(df), windows.drop_halo(run(cut))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_offsets_off_the_grid():
    assert windows.delta_offsets([i / 30 for i in range(-10, 10)], 30) == list(range(-10, 10))
    with pytest.raises(ValueError):
        windows.delta_offsets([0.02], 30)


def test_interpolation(spark):
    df = spark.createDataFrame([(k, 0, k, v) for k, v in enumerate([None, 1.0, None, 3.0, float("nan")])] + [(9, 1, 0, None)], FRAMES + ", p double")
    assert col(windows.interpolate(df, "p"), "p_filled") == [1.0, 1.0, 2.0, 3.0, 3.0, None]


def test_smoothing_keeps_cubics():
    x = np.arange(30.0)
    y = 0.01 * x**3 - x + 4
    assert np.allclose(windows.smoothing_weights(7)[3] @ y[:7], y[3])


def test_prefix_weights():
    assert windows.prefix_weights(2, 5, 7, "zeros") == [1, 1, 0, 0, 0, 0, 0] and windows.prefix_weights(2, 5, 7, "ones") == [1, 1, 1, 1, 1, 0, 0]
    assert np.allclose(windows.prefix_weights(2, 5, 7, "linear"), [1, 1, 0.75, 0.5, 0.25, 0, 0]) and windows.prefix_weights(9, 3, 4, "linear") == [1, 1, 1, 0]


# --- joins ---


def test_nearest_in_time_ties_and_padding(spark):
    f = spark.createDataFrame([(7, 0, 1.0), (3, 0, 1.0), (9, 0, 3.0), (1, 1, None)], "index long, episode_index long, timestamp double")
    q = spark.createDataFrame([(1, 0, 2.0), (2, 0, 9.0), (3, 5, 1.0), (4, 0, 1.0)], "query_id long, episode_index long, ts double")
    got = {r.query_id: (r["index"], r.is_pad) for r in joins.nearest_in_time(q, f, 1.5).collect()}
    assert got == {1: (3, False), 2: (9, True), 3: (None, True), 4: (3, False)}


def test_stages(spark):
    s = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in ((0, 2, 5), (1, 8, 8))])
    xs = [r[0] for r in spark.range(11).select(windows.stage_and_tau(F.col("id"), F.lit(20), s, 2)).collect()]
    assert close(xs, [0, 0, 0, 1 / 3, 2 / 3, 1, 1, 1, 1.999, 1.999, 1.999])


# --- editing ---


def test_reindex_is_dense(spark):
    f = spark.createDataFrame([(k * 3, e, j) for k, (e, j) in enumerate([(5, 0), (5, 1), (2, 0), (9, 4), (2, 1), (2, 3)])] + [(99, None, 0)], FRAMES)
    got = sorted((r["index"], r.episode_index, r.old_episode_index, r.frame_index) for r in episodes.reindex(f).collect())
    assert got == [(0, 0, 2, 0), (1, 0, 2, 1), (2, 0, 2, 3), (3, 1, 5, 0), (4, 1, 5, 1), (5, 2, 9, 4)]
    assert episodes.reindex(f.limit(0)).count() == 0


def test_fraction_ranges():
    assert episodes.fraction_ranges(10, {"a": 0.5, "b": 0.2}) == {"a": (0, 5), "b": (5, 10)}
    assert episodes.fraction_ranges(3, {"a": 0.5, "b": 0.1}) == {"a": (0, 1)}
    with pytest.raises(ValueError):
        episodes.fraction_ranges(3, {"a": 0.9, "b": 0.2})


def test_editing_errors(spark):
    e = spark.createDataFrame([(1,), (2,)], "episode_index long")
    for ids in ([3], [1, 2]):
        with pytest.raises(ValueError):
            episodes.check_episodes(e, ids)
    with pytest.raises(ValueError):
        episodes.drop_episodes(e, [])
    with pytest.raises(ValueError):
        episodes.remove_features(e.withColumn("index", F.lit(1)), ["index"])
    with pytest.raises(ValueError):
        episodes.parse_episode_spec("0-9", 5)
    with pytest.raises(ValueError):
        episodes.check_disjoint({"a": [1], "b": [1]})
    with pytest.raises(ValueError):
        episodes.label_success(e, [1], [1])


def test_shards_are_padded(spark):
    rows = sorted((r.shard, r["index"]) for r in episodes.padded_shards(spark.range(5).withColumnRenamed("id", "index"), 5, 3).collect())
    assert rows == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 4)]


def test_layout_types():
    t = dataset.feature_type
    assert t({"dtype": "video", "shape": (1,)}) is None and t({"dtype": "float32", "shape": (2, 3)}).simpleString() == "array<array<float>>"
    with pytest.raises(ValueError):
        dataset.frame_schema({"a/b": {"dtype": "int64", "shape": (1,)}})
    d = {"a": {"b": 1, "c": {"d": [2]}}}
    assert dataset.unflatten(dataset.flatten(d)) == d


def test_round_trip_of_a_dataset(spark, tmp_path):
    f = spark.createDataFrame([(k, k // 5, k % 5, 0) for k in range(20)], FRAMES + ", task_index long")
    root = f"file://{tmp_path}/d"
    dataset.write_frames(f, root, 4)
    assert sorted(map(tuple, dataset.scan_frames(spark, root).select(*f.columns).collect())) == sorted(map(tuple, f.collect()))
    dataset.update_columns(spark, root, spark.createDataFrame([(3, 9.0)], "index long, v double"), {"v": math.nan})
    got = {r["index"]: r.v for r in dataset.scan_frames(spark, root).collect()}
    assert len(got) == 20 and got[3] == 9.0 and math.isnan(got[4])


# --- pipelines and streams ---


def test_pipeline_errors(spark, tmp_path):
    with pytest.raises(KeyError):
        pipeline.Registry.get("nothing")
    p = pipeline.Pipeline([pipeline.TimeLimit(3)], "p")
    p.save(str(tmp_path))
    with pytest.raises(KeyError):
        pipeline.Pipeline.load(str(tmp_path), "p", {"other": {}})
    seen = []
    p.before.append(lambda i, df: seen.append(i))
    assert [r.truncated for r in p(spark.range(4).withColumnRenamed("id", "frame_index")).collect()] == [False, False, True, True] and seen == [0] and len(p[:1]) == 1


def test_observation_dedup_compares_with_the_last_processed(spark):
    rows = [(1, k, k, [x], False) for k, x in enumerate([0.0, 0.6, 1.2, 1.3, 5.0])] + [(1, 9, 4, [99.0], False), (1, 10, 4, [99.0], True)]
    got = [r.seq for r in queues.dedup_observations(spark.createDataFrame(rows, queues.OBSERVATION), 1.0).orderBy("seq").collect()]
    assert got == [0, 2, 4, 10]


def test_action_merge_drops_late_steps(spark):
    old = spark.createDataFrame([(1, 5, [1.0]), (1, 6, [1.0])], "robot long, timestep long, action array<double>")
    new = spark.createDataFrame([(1, 4, [3.0]), (1, 5, [3.0]), (1, 7, [3.0])], "robot long, timestep long, action array<double>")
    out = queues.merge_actions(old, new, spark.createDataFrame([(1, 4)], "robot long, latest long"), (0.3, 0.7))
    assert sorted((r.timestep, round(r.action[0], 9)) for r in out.collect()) == [(5, 2.4), (7, 3.0)]
