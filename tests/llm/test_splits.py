import math
import random

import pytest
from pyspark.sql import functions as F

from epistrata import runtime
from epistrata.llm import splits

SCHEMA = "episode_index long, operator_id string, scene_id string, source_episode_index long, v string, root long, `group` string, h int"


def brute(rows):
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def norm(s):
        s = None if s is None else s.strip().lower().replace("_", "-").replace(" ", "-")
        return None if s is None or s in splits.MISSING_WORDS or not s.strip("-") else s

    seen = {}
    for e, op, sc, src in rows:
        if e is None:
            continue
        for kind, k in (("o", norm(op)), ("s", norm(sc))):
            if k is not None:
                other = seen.setdefault((kind, k), e)
                parent[find(e)] = find(other)
        if src in parent:
            parent[find(e)] = find(src)
    groups = {}
    for e in parent:
        groups.setdefault(find(e), []).append(e)
    return {e: min(g) for g in groups.values() for e in g}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA)


def groups(spark, rows):
    f = splits.spanning_forest(frame(spark, rows))
    return {r.episode_index: r.group for r in f.groups.collect()}, f


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    ops = [None, "", "n/a", "UNKNOWN", "-", *[f"op-{k}" for k in range(60)], *[f" OP_{k} " for k in range(60)]]
    rows = [(e, rng.choice(ops), rng.choice([None, "none", *[f"scene {k}" for k in range(150)]]), rng.choice([None, None, None, rng.randrange(400)])) for e in range(250)]
    rows += rows[:20] + [(None, "op-1", None, 3)]
    got, f = groups(spark, rows)
    assert got == brute(rows)
    edges = [(r.u, r.v) for r in f.edges.collect()]
    assert len(edges) == len(set(edges)) == 250 - len(set(got.values()))  # a forest: one edge fewer than records in each group


def test_a_long_chain_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 30)
    rows = [(e, None, None, e - 1) for e in range(1, 60)] + [(e, "Op 7", None, None) for e in range(100, 200)]
    got, _ = groups(spark, rows)
    assert got == brute(rows) and set(got.values()) == {1, 100}


def test_missing_ids_and_unknown_sources_tie_nothing(spark):
    rows = [(1, None, "N/A", 99), (2, "unknown", "n/a", None), (3, " - ", "", 3), (4, "__", "None", None), (5, "None", " unknown ", None)]
    got, _ = groups(spark, rows)
    assert got == {k: k for k in range(1, 6)}
    assert groups(spark, [])[0] == {}


def test_no_group_is_split_and_shares_are_near(spark):
    rows = [(e, f"op-{e // 3}", None, None) for e in range(3000)] + [(e, "big", None, None) for e in range(3000, 4000)]
    _, f = groups(spark, rows)
    t = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("test", 0.1)], "split_name string, fraction double")
    out = splits.deal_splits(f.groups, t)
    assert out.count() == 4000 and out.groupBy("group").agg(F.count_distinct("split_name").alias("n")).filter("n <> 1").count() == 0
    share = {r.split_name: r["count"] / 4000 for r in out.groupBy("split_name").count().collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["val"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert sorted(map(str, splits.deal_splits(f.groups, t).collect())) == sorted(map(str, out.collect()))


def brute_deal(sizes, fractions, seed=7):
    """The dealing rule root by root: {group: split}."""
    import hashlib

    place = lambda g: int(hashlib.md5(f"{g}:{seed}".encode()).hexdigest()[:13], 16)
    names = [n for n, _ in sorted(fractions.items(), key=lambda x: (-x[1], x[0]))]
    total = sum(sizes.values())
    lack = {n: fractions[n] / sum(fractions.values()) * total for n in names}
    out = {}
    for band in sorted({int(math.log2(n)) for n in sizes.values()}, reverse=True):
        roots = sorted((g for g in sizes if int(math.log2(sizes[g])) == band), key=place)
        short = {n: max(0.0, lack[n]) for n in names}
        due = {n: short[n] / sum(short.values()) for n in names}
        kept = {n: due[n] for n in names if due[n] * len(roots) >= 0.5} or {max(names, key=lambda n: due[n]): 1.0}
        whole, at = sum(sizes[g] for g in roots), 0
        for g in roots:
            middle, end = at + sizes[g] / 2, 0.0
            for n in names:
                end += kept.get(n, 0.0) / sum(kept.values()) * whole
                if middle < end - 1e-9:
                    break
            out[g] = n
            at += sizes[g]
        for g in roots:
            lack[out[g]] -= sizes[g]
    return out


@pytest.mark.parametrize("cuts", [4096, 64])
def test_dealing_follows_one_rule_at_every_size(spark, monkeypatch, cuts):
    monkeypatch.setattr(splits, "BAND_CUTS", cuts)
    rng = random.Random(4)
    sizes = {g * 10_000: n for g, n in enumerate([1500, 400, 300, 130, 70, 64, 40] + [rng.randrange(1, 9) for _ in range(900)])}
    records = spark.createDataFrame([(g + k, g) for g, n in sizes.items() for k in range(n)], "episode_index long, `group` long")
    t = spark.createDataFrame([("train", 0.7), ("val", 0.2), ("test", 0.1)], "split_name string, fraction double")
    out = splits.deal_splits(records, t)
    got = {r.group: r.split_name for r in out.select("group", "split_name").distinct().collect()}
    assert len(got) == len(sizes)
    if cuts == 4096:
        assert got == brute_deal(sizes, {"train": 0.7, "val": 0.2, "test": 0.1})
    total = sum(sizes.values())
    for name, f in (("train", 0.7), ("val", 0.2), ("test", 0.1)):
        assert abs(sum(sizes[g] for g in got if got[g] == name) / total - f) < 0.005
    ones = {n: [g for g in got if sizes[g] == 1 and got[g] == n] for n in ("train", "val", "test")}
    assert all(ones.values())  # stratified: every split has roots of the smallest band


def test_more_than_a_thousand_splits(spark):
    _, f = groups(spark, [(e, None, None, None) for e in range(3000)])
    t = spark.createDataFrame([(f"s{k:04}", 1.0) for k in range(1500)], "split_name string, fraction double")
    got = splits.deal_splits(f.groups, t).groupBy("split_name").count().collect()
    assert len(got) == 1500 and {r["count"] for r in got} == {2}


def test_weights_are_balanced(spark):
    rng = random.Random(9)
    w = {e: rng.choice([1, 5, 100, 1000]) for e in range(2000)}
    _, f = groups(spark, [(e, f"op-{e // 2}", None, None) for e in range(2000)])
    t = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, fraction double")
    weights = spark.createDataFrame([(e, float(x)) for e, x in w.items() if e % 50] + [(0, None), (50, float("nan")), (None, 3.0)], "episode_index long, weight double")
    got = {r.episode_index: r.split_name for r in splits.deal_splits(f.groups, t, weights=weights).collect()}
    assert len(got) == 2000 and all(got[e] == got[e + 1] for e in range(0, 2000, 2))
    total = sum(x for e, x in w.items() if e % 50)
    for name, part in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(x for e, x in w.items() if e % 50 and got[e] == name) / total - part) < 0.005


def test_odd_targets(spark):
    _, f = groups(spark, [(e, None, None, None) for e in range(50)])
    t = lambda rows: spark.createDataFrame(rows, "split_name string, fraction double")
    assert {r.split_name for r in splits.deal_splits(f.groups, t([])).collect()} == {None}
    assert {r.split_name for r in splits.deal_splits(f.groups, t([("a", 2.0), ("b", None), ("c", float("nan")), ("d", -1.0), (None, 1.0)])).collect()} == {"a"}
    assert splits.deal_splits(f.groups.limit(0), t([("a", 1.0)])).count() == 0


def test_report_counts_frames_once(spark):
    s = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "episode_index long, `group` long, split_name string")
    fr = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 12), (9, 13), (None, 14)], "episode_index long, index long")
    t = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.1)], "split_name string, fraction double")
    got = {r.split_name: (r.episodes, r.frames) for r in splits.split_report(s, fr, t).collect()}
    assert got == {"a": (1, 2), "b": (1, 1), "c": (0, 0), None: (0, 2)}
    assert sorted((r["index"], r.split_name) for r in splits.frames_with_split(fr.filter("episode_index < 9"), s).collect()) == [(10, "a"), (11, "a"), (12, "b")]
