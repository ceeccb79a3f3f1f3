import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epistrata.llm import nearest_time as nt

S = "sample_id long, episode_index long, sensor_key string, timestamp double, reading double, t double, e long, s string"
FR = "index long, episode_index long, timestamp float, id long, kind string, tol double"


def run(spark, samples, frames, tol, **more):
    s = spark.createDataFrame([(*r, 0.0, 1.0, 1, "x") for r in samples], S)
    f = spark.createDataFrame([(*r, 1, "x", 2.0) for r in frames], FR)
    c = spark.createDataFrame(tol, "sensor_key string, tolerance_s double")
    return sorted((r.sample_id, r["index"]) for r in nt.match_nearest(s, f, c, **more).collect())


def brute(samples, frames, tol):
    limits = {}
    for k, t in tol:
        if k is not None and t is not None and t >= 0:
            limits[k] = max(t, limits.get(k, -1))
    ok = lambda t: t is not None and math.isfinite(t)
    out = set()
    for sid, e, key, t, *_ in samples:
        if sid is None or e is None or not ok(t) or key not in limits:
            continue
        near = [(abs(t - float(np.float32(ft))), i) for i, fe, ft in frames if fe == e and i is not None and ok(ft)]
        if near and min(near)[0] <= limits[key]:
            out.add((sid, min(near)[1]))
    return sorted(out)


@pytest.mark.parametrize("rows", [nt.CHUNK_ROWS, 7, 1])
def test_equals_brute_force(spark, rows):
    rng = random.Random(3)
    frames, i = [], 0
    for e in range(6):
        t = rng.uniform(-3, 1)
        for _ in range(rng.randrange(0, 120)):
            t += rng.choice([0.0, 0.033, 0.04, 1.5, rng.random()])
            frames.append((i, e, t))
            i += rng.randrange(1, 4)
    frames += rng.sample(frames, 20) + [(None, 1, 0.5), (900, None, 0.5), (901, 1, None), (902, 1, float("nan")), (903, 1, float("inf"))]
    rng.shuffle(frames)
    samples = [(k, rng.randrange(0, 8), rng.choice(["a", "b", "c", None]), rng.uniform(-4, 20)) for k in range(600)]
    samples += [(1000 + k, f[1], "a", None if f[2] is None else float(np.float32(f[2])) + rng.choice([0, 0.01, -0.01])) for k, f in enumerate(frames[:100])]
    samples += samples[:30] + [(2000, 1, "a", None), (2001, 1, "a", float("nan")), (None, 1, "a", 0.0), (2002, None, "a", 0.0), (2003, 1, "a", float("-inf"))]
    tol = [("a", 0.02), ("a", 0.01), ("b", float("inf") if rows == 7 else 0.3), ("c", None), ("d", -1.0), (None, 1.0)]
    assert run(spark, samples, frames, tol, chunk_rows=rows) == brute(samples, frames, tol)


def test_ties_take_the_smaller_index(spark):
    frames = [(9, 1, 1.0), (4, 1, 2.0), (7, 1, 2.0), (3, 1, 4.0)]
    assert run(spark, [(1, 1, "a", 1.5), (2, 1, "a", 3.0), (3, 1, "a", 2.0)], frames, [("a", 5.0)]) == [(1, 4), (2, 3), (3, 4)]


def test_an_infinite_tolerance_is_one(spark):
    """A sensor's result does not depend on other sensors, and times may be of any finite size."""
    frames = [(1, 1, 0.0), (2, 2, 1e30), (3, 3, 3.0e15)]
    samples = [(1, 1, "a", 95.0), (2, 1, "b", 95.0), (3, 2, "a", -1e300), (4, 3, "a", 3.0e15)]
    assert run(spark, samples, frames, [("a", float("inf"))]) == brute(samples, frames, [("a", float("inf"))]) == [(1, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("parts,rows", [(1, 3), (7, 1000), (23, 5)])
def test_one_entity_over_many_partitions(spark, parts, rows):
    """A hot entity, a hot instant and long stretches of samples without frames, cut into ranges anywhere."""
    rng = random.Random(parts)
    frames = [(k, 1, float(np.float32(rng.choice([5.0, 9.0, 9.0, rng.uniform(0, 20)])))) for k in rng.sample(range(500), 120)] + [(900, 2, 1.0)]
    samples = [(k, rng.choice([1, 1, 1, 2, 3]), rng.choice("ab"), rng.choice([5.0, 9.0, 9.0, rng.uniform(-40, 60), rng.uniform(20, 60)])) for k in range(600)]
    tol = [("a", 0.5), ("b", float("inf"))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, samples, frames, tol, chunk_rows=rows) == brute(samples, frames, tol)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_samples_can_be_kept(spark):
    got = run(spark, [(1, 1, "a", 1.0), (1, 1, "a", 1.0), (2, 1, "a", None), (3, 5, "a", 1.0)], [(9, 1, 1.0)], [("a", 0.1)], keep_unmatched=True)
    assert [x for x in got if x[1] is not None] == [(1, 9)] and sorted(x[0] for x in got) == [1, 2, 3]


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1.0)], [("a", 1.0)]) == [] and run(spark, [(1, 1, "a", 1.0)], [], [("a", 1.0)]) == [] and run(spark, [(1, 1, "a", 1.0)], [(1, 1, 1.0)], []) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6, width=32), max_size=200, unique=True), min_size=1, max_size=4), st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.integers(1, 8))
def test_index_finds_positions(shards, queries, epsilon):
    shards = [np.array(sorted(s)) for s in shards]
    t = np.concatenate(shards) if sum(map(len, shards)) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in shards])])
    if not t.size:
        return
    q = np.array(queries * len(shards))
    which = np.repeat(np.arange(len(shards)), len(queries))
    got = nt.LearnedIndex(t, starts, epsilon).right_of(q, which, starts)
    assert got.tolist() == [int(starts[w] + np.searchsorted(shards[w], x, "right")) for x, w in zip(q, which)]


def test_one_segment_serves_an_even_clock():
    t = np.arange(10_000) / 30
    assert nt.LearnedIndex(t, np.array([0, t.size])).lo.size == 1
