import datetime as dt
import json

import hypothesis.strategies as st
from hypothesis import given, settings

from epistrata.operators import schema_drift as sd

FILES = "file_id long, repo_id string, file_index long, path string, written_at timestamp, info string, extra string, record_id long"
T0 = dt.datetime(2025, 1, 1)


def info(fields, **top):
    feats = {n: {"dtype": d, "shape": s, "names": names} for n, (d, s, names) in fields.items()}
    return json.dumps({"fps": 30, "robot_type": "arm", **top, "features": feats})


def frame(spark, rows):
    return spark.createDataFrame([(i, r, k, "p", T0 + dt.timedelta(days=i), t, "x", i) for i, (r, k, t) in enumerate(rows)], FILES)


def changes(spark, rows):
    out = sd.schema_changes(frame(spark, rows))
    return sorted((r.repo_id, r.file_index, r.change, r.old_field, r.new_field) for r in out.collect())


A, B, C = ("float32", [6], ["a"]), ("float32", [6], ["b"]), ("int64", [1], None)


def test_rename_add_remove_type(spark):
    rows = [
        ("r", 1, info({"x": A, "y": B, "z": C})),
        ("r", 2, "{not json"),
        ("r", 4, info({"x2": A, "y": ("float64", [6], ["b"]), "z": C}, fps="30")),
        ("r", 4, info({"other": C})),  # second delivery
        ("r", 9, info({"x2": A, "w": C, "v": C})),
    ]
    assert changes(spark, rows) == sorted([
        ("r", 4, "renamed", "features.x", "features.x2"), ("r", 4, "type_changed", "features.y", "features.y"), ("r", 4, "type_changed", "fps", "fps"), ("r", 9, "type_changed", "fps", "fps"),
        ("r", 9, "removed", "features.y", ""), ("r", 9, "removed", "features.z", ""), ("r", 9, "added", "", "features.w"), ("r", 9, "added", "", "features.v"),
    ])


def test_nulls_case_and_empty(spark):
    rows = [("r", 1, info({"State": A}, robot_type=None)), ("r", 2, info({"state": A}, robot_type="arm")), (None, 3, info({})), ("r", None, info({})), ("r", 5, None), ("s", 1, "")]
    assert changes(spark, rows) == [("r", 2, "renamed", "features.State", "features.state")]
    assert changes(spark, []) == []


def test_a_repo_over_many_partitions(spark):
    rows = [("hot", i, info({f"f{i // 10}": A})) for i in range(100)] + [(f"r{i}", 1, info({"a": A})) for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = changes(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(("hot", 10 * k, "renamed", f"features.f{k - 1}", f"features.f{k}") for k in range(1, 10))


def test_moves_are_found_in_nested_schemas():
    leaf = lambda n: sd.Node(n, "t")
    a = sd.Node("", None, "", {"p": sd.Node("p", "o", "", {"x": leaf("x"), "y": sd.Node("y", "u")}), "q": sd.Node("q", "o")})
    b = sd.Node("", None, "", {"p": sd.Node("p", "o", "", {"y": sd.Node("y", "u")}), "q": sd.Node("q", "o", "", {"x": leaf("x")})})
    cost, edits = sd.edit_script(a, b)
    assert edits == [("moved", "p.x", "q.x", sd.MOVE)] and cost == sd.MOVE


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 2)), max_size=5, unique_by=lambda x: x[0]), st.lists(st.tuples(st.sampled_from("uvwxyz"), st.integers(0, 2)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 3))
def test_scripts_cost_least(old, new, inner):
    """Against every way to pair gone with new fields of a type that is alone on either side."""
    import itertools

    node = lambda n, t: sd.Node(n, f"t{t}", "", {f"{n}{k}": sd.Node(f"{n}{k}", "leaf") for k in range(inner if t == 0 else 0)})
    a, b = (sd.Node("", None, "", {n: node(n, t) for n, t in side}) for side in (old, new))
    lone = [(x, y) for x, t in old for y, u in new if t == u and [v for _, v in old].count(t) == [v for _, v in new].count(t) == 1]
    least = sum(x.size() for x in a.children.values()) + sum(y.size() for y in b.children.values())
    for k in range(len(lone) + 1):
        for pairs in itertools.combinations(lone, k):
            cost = sum(x.size() for n, x in a.children.items() if n not in [p for p, _ in pairs]) + sum(y.size() for n, y in b.children.items() if n not in [q for _, q in pairs])
            for p, q in pairs:
                below = sd.edit_script(sd.Node("", None, "", a.children[p].children), sd.Node("", None, "", b.children[q].children))[0]
                cost += sd.RENAME + below
            least = min(least, cost)
    assert abs(sd.edit_script(a, b)[0] - least) < 1e-9


def test_many_renames_take_time_in_proportion():
    import time

    tree = lambda p: sd.Node("", None, "", {f"{p}{k}": sd.Node(f"{p}{k}", f"t{k}") for k in range(20_000)})
    began = time.perf_counter()
    cost, edits = sd.edit_script(tree("a"), tree("b"))
    assert cost == 20_000 * sd.RENAME and {e[0] for e in edits} == {"renamed"} and time.perf_counter() - began < 20


def test_unified_table_follows_renames(spark):
    files = frame(spark, [("r", 1, info({"x": A, "t": C})), ("r", 2, info({"x2": A, "t": C})), ("r", 3, info({"x3": A, "t": C}, fps="50")), ("s", 1, info({"X": C}))])
    recs = spark.createDataFrame([
        (1, 0, '{"x": [1, 2], "t": 1}'), (2, 1, '{"x2": [3.5], "t": "2"}'), (3, 2, '{"x3": null, "t": 3.5}'), (3, 2, '{"x3": null, "t": 3.5}'), (4, 3, '{"X": "a", "repo_id": 1}'), (5, 99, '{"x": 5}'), (6, 0, None), (7, 0, "nonsense"),
    ], "record_id long, file_id long, record string")
    u = sd.unified_records(files, recs)
    rows = {r["_record_id"]: r for r in u.table.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7] and u.table.count() == 7
    x = "x" if "x" in u.table.columns else "x~2"
    assert rows[1][x] == [1.0, 2.0] and rows[2][x] == [3.5] and rows[3][x] is None and rows[5][x] == [5.0]
    assert [rows[i]["t"] for i in (1, 2, 3)] == [1.0, 2.0, 3.5]
    assert rows[3]["_fps"] == "50" and rows[4]["_repo_id"] == "s" and rows[5]["_repo_id"] is None and rows[6]["t"] is None


def test_unified_overflow_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(sd, "MAX_COLUMNS", 1)
    files = frame(spark, [("r", 1, info({"a": C}))])
    recs = spark.createDataFrame([(1, 0, '{"a": 1, "b": 2, "c": "x"}'), (2, 0, '{"a": 3}')], "record_id long, file_id long, record string")
    rows = {r["_record_id"]: r for r in sd.unified_records(files, recs).table.collect()}
    assert rows[1]["a"] == 1 and rows[1]["_extra"] == {"b": "2", "c": "x"} and rows[2]["_extra"] is None


def test_types_unify():
    assert sd.unify({"whole", "null"}) == "bigint" and sd.unify({"whole", "decimal_text"}) == "double" and sd.unify({"boolean", "whole"}) == "double"
    assert sd.unify({"numbers", "whole"}) == "array<double>" and sd.unify({"list"}) == "array<string>" and sd.unify({"object", "whole"}) == "string" and sd.unify(set()) == "string"


def test_keys_stay_whole_numbers_and_texts_stay_texts(spark):
    files = frame(spark, [("r", 1, info({"a": C})), ("r", 2, info({"a": C}))])
    recs = spark.createDataFrame([(1, 0, '{"key": 7, "code": "007", "t": 1.0, "only": "12", "mix": 3}'), (2, 1, '{"key": 7.0, "code": 7, "t": 2.0, "only": "13", "mix": "4"}'), (3, 1, '{"key": "9", "mix": 5.0}')], "record_id long, file_id long, record string")
    u = sd.unified_records(files, recs).table
    kinds = dict(u.dtypes)
    assert [kinds[k] for k in ("key", "code", "t", "only", "mix")] == ["bigint", "string", "double", "string", "bigint"]
    rows = {r["_record_id"]: r for r in u.collect()}
    assert [rows[k]["key"] for k in (1, 2, 3)] == [7, 7, 9] and rows[1]["code"] == "007" and rows[2]["code"] == "7" and [rows[k]["mix"] for k in (1, 2, 3)] == [3, 4, 5]


def test_last_before_carries_over_stretches(spark, monkeypatch):
    import random

    rng = random.Random(2)
    monkeypatch.setattr(sd, "AS_OF_BLOCK", 8)
    arrivals = sorted({(r, rng.randrange(0, 200)): f"v{k}" for k in range(60) for r in ("a", "b")}.items())
    queries = [(r, k, rng.randrange(-20, 300)) for k, r in enumerate(["a", "b", "c"] * 60)]
    a = spark.createDataFrame([(r, at, v) for (r, at), v in arrivals], "repo_id string, since long, origin string")
    q = spark.createDataFrame(queries, "repo_id string, file_id long, file_index long")
    got = {r.file_id: r.origin for r in sd.last_before(q, a, ["repo_id"], "origin").collect()}
    assert got == {k: max([(at, v) for (s, at), v in arrivals if s == r and at <= i], default=(0, None))[1] for r, k, i in queries}
