import math
import random

import pytest

from epistrata.llm import cutoff

R = "task_index long, index long, `complementary_info.advantage_v1` double, s string, x string, cutoff int"


def run(spark, rows, targets):
    r = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], R)
    c = cutoff.fraction_cutoffs(r, spark.createDataFrame(targets, "task_index long, keep_pct double"))
    return {x.task_index: (x.n_counted, x.cutoff, x.n_kept) for x in c.cutoffs.collect()}, sorted((x.task_index, x["index"]) for x in c.kept().collect())


def brute(rows, targets):
    pct = {}
    for s, p in targets:
        if s is not None and p is not None and not math.isnan(p):
            pct[s] = max(p, pct.get(s, -1e9))
    cuts, kept = {}, set()
    for s, p in pct.items():
        xs = {(i, x) for t, i, x in rows if t == s and i is not None and x is not None and not math.isnan(x)}
        ok = [c for _, c in xs if sum(y >= c for _, y in xs) * 100 >= p * len(xs)]
        cut = max(ok) if ok else None
        keep = {(s, i) for i, x in xs if cut is not None and x >= cut}
        cuts[s] = (len(xs), cut, len(keep))
        kept |= keep
    return cuts, sorted(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    draw = {0: lambda: rng.gauss(0, 1), 1: lambda: round(rng.random(), 1), 2: lambda: math.exp(rng.gauss(0, 5)), 3: lambda: 7.0, 4: lambda: rng.choice([-1e300, 1e300, 0.0, -0.0, 1e-300])}
    rows = [(s, 1000 * s + k, draw[s]()) for s in draw for k in range(rng.randrange(1, 200))]
    rows += rng.sample(rows, 30) + [(0, None, 1.0), (0, 5000, None), (1, 5001, float("nan")), (None, 5002, 1.0), (9, 5003, 1.0)]
    rng.shuffle(rows)
    targets = [(s, rng.choice([1.0, 10.0, 33.0, 50.0, 99.0, 100.0])) for s in range(5)] + [(8, 50.0), (None, 5.0)]
    assert run(spark, rows, targets) == brute(rows, targets)


def test_edges(spark):
    rows = [(1, k, float(k % 4)) for k in range(40)] + [(2, 100, float("inf")), (2, 101, float("-inf")), (2, 102, 0.0)]
    targets = [(1, 0.0), (2, 50.0), (2, None), (3, 10.0)]
    assert run(spark, rows, targets) == brute(rows, targets)
    cuts, kept = run(spark, rows, [(1, 101.0), (2, -5.0)])
    assert cuts == {1: (40, None, 0), 2: (3, float("inf"), 1)} and kept == [(2, 100)]
    assert run(spark, [], [(1, 50.0)]) == ({1: (0, None, 0)}, []) and run(spark, rows, []) == ({}, [])


def test_smallest_k_is_exact(spark):
    rows = [(1, k, float(k)) for k in range(7)]
    for p in (14.0, 14.285714285714286, 15.0, 28.57142857142857, 29.0, 100.0 / 7 * 3):
        assert run(spark, rows, [(1, p)]) == brute(rows, [(1, p)])
