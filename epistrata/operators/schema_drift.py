"""Schemas that drift between files: edit scripts between schema trees, compiled into one projection a file."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epistrata.runtime import Workspace, hot_join, lookup_join

#: Cost of an edit; a pair of an add and a delete costs 2 a node, so a rename or move of a field is cheaper.
ADD = DELETE = 1.0
RETYPE, RENAME, MOVE = 1.0, 1.5, 1.25
#: Columns of the unified table beyond which further fields go into the map column ``_extra``; nothing is lost.
MAX_COLUMNS = 256
#: Rows that a task turns into columns at once.
SLICE_ROWS = 2000


@dataclass
class Node:
    """A field: its type (None: not known), what else must agree for a rename, and the fields inside."""

    name: str
    type: str | None = None
    mark: str = ""
    children: dict[str, "Node"] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(x.size() for x in self.children.values())

    def shape(self) -> tuple:
        """What a renamed or moved field keeps."""
        return (self.type, self.mark, tuple(sorted((n, x.shape()) for n, x in self.children.items())))


Edit = tuple[str, str, str, float]  # change, old path, new path, cost


def _below(a: Node, b: Node, at_a: str, at_b: str, gone: list[tuple[str, Node]], new: list[tuple[str, Node]]) -> tuple[float, list[Edit]]:
    """Least-cost edits between the children of two matched nodes; what is left over on either side goes to gone and new.

    Children of one name are the same field. A field may be taken for another only if type and mark agree and no other field left over on either side
    has them, so each has at most one partner, and the least-cost assignment of all is the choice, pair by pair, of what costs less: the
    rename with the edits inside it, or the delete and the add. It takes time in proportion to the fields.
    """
    cost, edits = 0.0, []
    for name in a.children.keys() & b.children.keys():
        x, y = a.children[name], b.children[name]
        if x.type is not None and y.type is not None and x.type != y.type:
            cost += RETYPE
            edits.append(("type_changed", at_a + name, at_b + name, RETYPE))
        more, inside = _below(x, y, f"{at_a}{name}.", f"{at_b}{name}.", gone, new)
        cost, edits = cost + more, edits + inside
    left = [a.children[n] for n in sorted(a.children.keys() - b.children.keys())]
    right = [b.children[n] for n in sorted(b.children.keys() - a.children.keys())]
    alike: dict[tuple, tuple[list[Node], list[Node]]] = {}
    for side, nodes in ((0, left), (1, right)):
        for x in nodes:
            alike.setdefault((x.type, x.mark), ([], []))[side].append(x)
    taken: set[int] = set()
    for xs, ys in alike.values():
        if len(xs) != 1 or len(ys) != 1:
            continue
        x, y = xs[0], ys[0]
        g: list[tuple[str, Node]] = []
        w: list[tuple[str, Node]] = []
        more, inside = _below(x, y, f"{at_a}{x.name}.", f"{at_b}{y.name}.", g, w)
        lost = DELETE * sum(k.size() for _, k in g) + ADD * sum(k.size() for _, k in w)
        if RENAME + more + lost < DELETE * x.size() + ADD * y.size():
            cost += RENAME + more
            edits += [("renamed", at_a + x.name, at_b + y.name, RENAME), *inside]
            gone += g
            new += w
            taken |= {id(x), id(y)}
    left = [x for x in left if id(x) not in taken]
    right = [y for y in right if id(y) not in taken]
    gone += [(at_a, x) for x in left]
    new += [(at_b, y) for y in right]
    return cost, edits


def edit_script(a: Node, b: Node) -> tuple[float, list[Edit]]:
    """Edit distance of two schema trees and a script of least cost: added, removed, renamed, type_changed, moved.

    A field that left one parent and joined another under the same name with the same type and content has moved.
    """
    gone: list[tuple[str, Node]] = []
    new: list[tuple[str, Node]] = []
    cost, edits = _below(a, b, "", "", gone, new)
    where: dict[tuple, list[int]] = {}
    for j, (path, y) in enumerate(new):
        where.setdefault((y.name, y.shape()), []).append(j)
    moved = set()
    for path, x in gone:
        spots = where.get((x.name, x.shape()), [])
        spot = next((j for j in spots if j not in moved and new[j][0] != path), None) if x.type is not None or x.children else None
        if spot is not None:
            moved.add(spot)
            edits.append(("moved", path + x.name, new[spot][0] + x.name, MOVE))
            cost += MOVE
        else:
            edits.append(("removed", path + x.name, "", DELETE * x.size()))
            cost += DELETE * x.size()
    for j, (path, y) in enumerate(new):
        if j not in moved:
            edits.append(("added", "", path + y.name, ADD * y.size()))
            cost += ADD * y.size()
    return cost, edits


def _kind(v: Any) -> str | None:
    """JSON kind of a value; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {int: "whole", float: "decimal", str: "text", list: "list", dict: "object"}[type(v)]


def info_tree(text: str | None) -> Node | None:
    """Schema tree of a metadata file: its top-level fields, and under ``features`` each feature; None if it cannot be read."""
    try:
        o = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    root = Node("")
    for k, v in o.items():
        if k == "features" and isinstance(v, dict):
            top = root.children[k] = Node(k, "features")
            for name, spec in v.items():
                if isinstance(spec, dict):
                    dtype, shape = spec.get("dtype"), spec.get("shape")
                    known = dtype is not None and shape is not None
                    top.children[name] = Node(name, "feature " + json.dumps([dtype, shape]) if known else None, json.dumps(spec.get("names"), sort_keys=True) if known else json.dumps(spec, sort_keys=True))
                else:
                    top.children[name] = Node(name, _kind(spec))
        elif k != "features":
            root.children[k] = Node(k, _kind(v), "null" if v is None else "")
    root.children.setdefault("features", Node("features", "features"))
    return root


CHANGES = "repo_id string, file_index long, change string, old_field string, new_field string, cost double"
_WALK = CHANGES + ", edge string, info string"


def _changes(repo: str, at: int, a: Node, b: Node) -> list[tuple]:
    return [(repo, at, change, old, new, cost) for change, old, new, cost in edit_script(a, b)[1]]


def _walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes between neighbours of a sorted partition; its first and last readable file go on as edges."""
    last: tuple[str, int, Node, str] | None = None
    began = False
    for pdf in it:
        rows: list[tuple] = []
        for repo, at, info in zip(pdf["repo_id"], pdf["file_index"], pdf["info"]):
            tree = info_tree(info)
            if tree is None or (last and last[0] == repo and last[1] == at):
                continue
            if not began:
                rows.append((repo, at, None, None, None, None, "first", info))
                began = True
            if last and last[0] == repo:
                rows += [(*x, None, None) for x in _changes(repo, int(at), last[2], tree)]
            last = (repo, int(at), tree, info)
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _WALK.split(", ")])
    if last:
        yield pd.DataFrame([(last[0], last[1], None, None, None, None, "last", last[3])], columns=[x.split()[0] for x in _WALK.split(", ")])


def _seam(pdf: pd.DataFrame) -> pd.DataFrame:
    """Changes between the last file of a partition and the first of the next, within one repo."""
    pdf = pdf.sort_values(["file_index", "edge"], kind="stable")
    rows, last = [], None
    for repo, at, edge, info in zip(pdf["repo_id"], pdf["file_index"], pdf["edge"], pdf["info"]):
        if edge == "first" and last is not None and last[0] != at:
            rows += _changes(repo, int(at), info_tree(last[1]), info_tree(info))
        if edge == "last":
            last = (at, info)
    return pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])


def schema_changes(files: DataFrame) -> DataFrame:
    """(repo_id, file_index, change, old_field, new_field, cost): what changed between each file and the readable one before it in its repo.

    Changes are the least-cost edit script between the two schema trees. Files are range-partitioned by repo and index, so a repo of any size is split;
    neighbours that fall into two partitions are compared in a second step over the partitions' edges, two rows a partition.

    ``change`` is added (old_field ''), removed (new_field ''), renamed, moved or type_changed. Unreadable files and null infos are passed over; of
    several readable deliveries of one index the first written counts. A null type on either side is no change, and a null is no type to
    rename by unless the other is null too. Files without repo or index are left out. Empty input gives no rows.
    """
    ws = Workspace(files.sparkSession, "drift")
    f = files.select("repo_id", F.col("file_index").cast("long").alias("file_index"), "written_at", "file_id", "info").filter("repo_id is not null and file_index is not null and info is not null")
    walked = f.repartitionByRange("repo_id", "file_index").sortWithinPartitions("repo_id", "file_index", "written_at", "file_id").select("repo_id", "file_index", "info").mapInPandas(_walk, _WALK)
    walked = ws.save(walked, "walked")
    names = [x.split()[0] for x in CHANGES.split(", ")]
    seams = walked.filter("edge is not null").select("repo_id", "file_index", "edge", "info").groupBy("repo_id").applyInPandas(_seam, CHANGES)
    return walked.filter("change is not null").select(*names).unionByName(seams)


def origins(changes: DataFrame) -> DataFrame:
    """(repo_id, name, since, origin): under which name a renamed or moved field first appeared, from file ``since`` on.

    Chains of renames are followed by pointer doubling, so a chain of n takes log n joins.
    """
    ws = Workspace(changes.sparkSession, "origins")
    ren = ws.save(changes.filter("change in ('renamed', 'moved')").select("repo_id", F.col("file_index").alias("at"), "old_field", "new_field").distinct(), "renames")
    # the rename before: the latest earlier one in the repo whose new name is this one's old name
    come = ren.select("repo_id", F.col("new_field").alias("name"), "at", F.struct("at", "old_field", "new_field").alias("hop"), F.lit(None).cast("string").alias("to"))
    go = ren.select("repo_id", F.col("old_field").alias("name"), "at", F.lit(None).cast(come.schema["hop"].dataType).alias("hop"), F.col("new_field").alias("to"))
    w = Window.partitionBy("repo_id", "name").orderBy("at", F.col("to").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    linked = come.unionByName(go).withColumn("prev", F.last("hop", True).over(w)).filter("to is not null")
    cur = ws.save(linked.select("repo_id", F.struct("at", F.col("name").alias("old_field"), F.col("to").alias("new_field")).alias("hop"), "prev", F.col("name").alias("origin")), "chain")
    while cur.filter("prev is not null").limit(1).count():
        up = cur.select("repo_id", F.col("hop").alias("prev"), F.col("prev").alias("prev2"), F.col("origin").alias("origin2"))
        cur = ws.save(cur.join(up, ["repo_id", "prev"], "left").select("repo_id", "hop", F.col("prev2").alias("prev"), F.coalesce("origin2", "origin").alias("origin")), "chain")
    return cur.select("repo_id", F.col("hop.new_field").alias("name"), F.col("hop.at").alias("since"), "origin")


#: Width of a stretch of file indices within which files meet the renames before them.
AS_OF_BLOCK = 4096


def last_before(queries: DataFrame, arrivals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, file_id, value): for each query (keys, file_id, file_index) the value of the last arrival (keys, since, value) with since <= file_index; null if none.

    Windows run over stretches of the index; what arrived before a stretch is carried over by a window over one row a stretch. So neither a repo with
    many files nor a name that changes often makes pairs or a group of its own size.
    """
    kind = arrivals.schema[value].dataType
    q = queries.select(*keys, "file_id", F.col("file_index").alias("at"), F.lit(1).alias("k"), F.lit(None).cast(kind).alias("v"))
    a = arrivals.select(*keys, F.lit(None).cast("long").alias("file_id"), F.col("since").alias("at"), F.lit(0).alias("k"), F.col(value).alias("v"))
    events = q.unionByName(a).withColumn("b", F.floor(F.col("at") / AS_OF_BLOCK))
    ends = events.groupBy(*keys, "b").agg(F.max_by("v", F.when(F.col("k") == 0, F.struct("at", "v"))).alias("e"))
    w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "b", F.last("e", True).over(w).alias("e"))
    inside = Window.partitionBy(*keys, "b").orderBy("at", "k", "v", "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("s", F.last("v", True).over(inside)).filter("k = 1")
    return seen.join(carried, [*keys, "b"], "left").select(*keys, "file_id", F.coalesce("s", "e").alias(value))


def _width(v: int) -> str | None:
    """wide: a whole number that a double may round; huge: one that has no place in a bigint."""
    return None if abs(v) <= 2**53 else "wide" if -(2**63) <= v < 2**63 else "huge"


def _number_in(text: str) -> int | float | None:
    """The number that a text spells, if it comes out of it again digit for digit; else it is a text."""
    try:
        n: int | float = int(text)
    except ValueError:
        try:
            n = float(text)
        except ValueError:
            return None
    return n if str(n) == text and n - n == 0 else None


def _value_kind(v: Any) -> str:
    k = _kind(v)
    if k == "text":
        n = _number_in(v)
        return "text" if n is None else f"{_value_kind(n)}_text"
    if k == "whole":
        return _width(v) or k
    if k == "decimal":
        return "integral" if abs(v) <= 2**53 and v == int(v) else k
    if k == "list":
        return "numbers" if all(x is None or _kind(x) == "decimal" or (_kind(x) == "whole" and not _width(x)) for x in v) else "list"
    return k or "null"


def unify(kinds: set[str]) -> str:
    """The narrowest column type that holds all kinds of values a field has, digit for digit.

    Texts of numbers count as numbers only beside numbers, and truth values beside them are 1 and 0. 7.0 beside whole numbers is one; where all numbers are written with a point they are decimals.
    """
    kinds = kinds - {"null"}
    plain = {k.removesuffix("_text") for k in kinds}
    if not kinds or plain & {"text", "object", "huge"} or all(k.endswith("_text") for k in kinds):
        return "string"
    if plain & {"numbers", "list"}:
        if "list" in kinds:
            return "array<string>" if kinds <= {"numbers", "list"} else "string"
        return "array<double>" if plain <= {"numbers", "whole", "integral", "decimal"} else "string"
    if kinds == {"boolean"}:
        return "boolean"
    if plain <= {"whole", "wide", "integral"} and plain & {"whole", "wide"}:
        return "bigint"
    return "string" if "wide" in plain else "double"


def _fit(v: Any, to: str) -> Any:
    if v is None:
        return None
    if to == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if to == "boolean":
        return v
    if to == "bigint":
        return int(_number_in(v) if isinstance(v, str) else v)
    if to == "double":
        return float(v)
    if to == "array<double>":
        return [None if x is None else float(x) for x in (v if isinstance(v, list) else [v])]
    return [x if isinstance(x, str) or x is None else json.dumps(x) for x in v]


def _parse(text: str | None) -> dict:
    try:
        o = json.loads(text or "")
    except ValueError:
        return {}
    return o if isinstance(o, dict) else {}


def _survey(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        seen = set()
        for fid, text in zip(pdf["file_id"], pdf["record"]):
            seen.update((fid, k, _value_kind(v)) for k, v in _parse(text).items())
        yield pd.DataFrame(sorted(seen), columns=["file_id", "key", "kind"])


@dataclass
class Unified:
    """table: all records under one schema. fields: field, column, type, kinds, files, renamed_in (files where it bears another name). projections: file_id, key, field."""

    table: DataFrame
    fields: DataFrame
    projections: DataFrame


def unified_records(files: DataFrame, records: DataFrame, changes: DataFrame | None = None) -> Unified:
    """All records of all files in one table with one schema.

    The edit scripts are compiled into a projection for every file: each key of its records to the name under which the field first
    appeared in its repo (its own name if it never changed, or if another key of the file has that name already). A field's column has the
    narrowest type that holds all its values digit for digit (see ``unify``): whole numbers bigint, also where some files write them as 7.0 or "7", other numbers double,
    lists of numbers (and numbers beside them) array<double>, all else string, with JSON text for what is no text. So texts stay texts where "007" or "1.50" occurs or no
    file writes a number; string too where whole numbers beyond 64 bits occur, or beyond 2**53 beside decimals (array<string> inside lists). Names that differ only in case get a suffix ~2, ~3 …

    Columns: _record_id, _file_id, _repo_id, _file_index, _fps, _robot_type (of the file, as text, whatever the file calls them), one a field; fields beyond MAX_COLUMNS
    are kept in the map _extra. Repeated rows count once. A record that is null or no JSON object has null fields; one whose file is unknown keeps its
    keys. Absent and null fields are null.
    """
    ws = Workspace(files.sparkSession, "unify")
    if changes is None:
        changes = schema_changes(files)
    changes = ws.save(changes, "changes")
    known = files.select("file_id", "repo_id", F.col("file_index").cast("long").alias("file_index"), "info").filter("file_id is not null")
    place = known.select("file_id", "repo_id", "file_index").distinct()
    rows = ws.save(records.select("record_id", "file_id", "record").distinct(), "records")
    kinds = ws.save(rows.select("file_id", "record").mapInPandas(_survey, "file_id long, key string, kind string").distinct(), "kinds")
    keys = kinds.select("file_id", "key").distinct()
    roots = ws.save(origins(changes), "roots")
    born = ws.save(roots.filter("name like 'features.%' and origin like 'features.%'").select("repo_id", F.expr("substr(name, 10)").alias("key"), "since", F.expr("substr(origin, 10)").alias("origin")), "born")
    here = hot_join(keys, place, ["file_id"], "left")
    drifted = lookup_join(here.filter("repo_id is not null and file_index is not null"), born.select("repo_id", "key").distinct(), ["repo_id", "key"], "left_semi")
    hits = last_before(drifted, born, ["repo_id", "key"], "origin").groupBy("file_id", "key").agg(F.max("origin").alias("origin"))
    named = keys.join(hits, ["file_id", "key"], "left").withColumn("field", F.coalesce("origin", "key"))
    w = Window.partitionBy("file_id", "field")  # the keys of one file
    named = named.withColumn("clash", F.count(F.lit(1)).over(w) > 1).select("file_id", "key", F.when(F.col("clash"), F.col("key")).otherwise(F.col("field")).alias("field"))
    projections = ws.save(named, "projections")
    per_file = kinds.join(projections, ["file_id", "key"]).groupBy("field", "file_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.max((F.col("key") != F.col("field")).cast("long")).alias("renamed_in"))
    fields = per_file.groupBy("field").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.count("file_id").alias("files"), F.sum("renamed_in").alias("renamed_in"))
    fields = ws.save(fields, "fields")
    catalog, seen = [], Counter()
    for r in fields.orderBy(F.desc("files"), "field").limit(MAX_COLUMNS).collect():
        seen[r["field"].lower()] += 1
        n = seen[r["field"].lower()]
        catalog.append((r["field"], r["field"] if n == 1 else f"{r['field']}~{n}", unify(set(r["kinds"]))))
    catalog.sort()
    fixed = [("_record_id", "bigint"), ("_file_id", "bigint"), ("_repo_id", "string"), ("_file_index", "bigint"), ("_fps", "string"), ("_robot_type", "string")]
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fixed] + [T.StructField(n, T._parse_datatype_string(t)) for _, n, t in catalog] + [T.StructField("_extra", T.MapType(T.StringType(), T.StringType()))])
    column = {f: (i, t) for i, (f, _, t) in enumerate(catalog)}

    kinds_of = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([pa.field(n, kinds_of[t]) for n, t in fixed] + [pa.field(n, kinds_of[t]) for _, n, t in catalog] + [pa.field("_extra", pa.map_(pa.string(), pa.string()))])

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(start, SLICE_ROWS)
                data: dict[int, list] = {}
                extra: list[dict | None] = [None] * b.num_rows
                for n, (text, names) in enumerate(zip(b.column(6).to_pylist(), b.column(7).to_pylist())):
                    to = dict(names) if names else {}
                    for k, v in _parse(text).items():
                        if v is None:
                            continue
                        f = to.get(k, k)
                        if f in column:
                            i, t = column[f]
                            if i not in data:
                                data[i] = [None] * b.num_rows
                            data[i][n] = _fit(v, t)
                        else:
                            extra[n] = {**(extra[n] or {}), f: _fit(v, "string")}
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(6)]
                cols += [pa.array(data[i], kinds_of[t]) if i in data else pa.nulls(b.num_rows, kinds_of[t]) for i, (_, _, t) in enumerate(catalog)]
                cols.append(pa.array([None if e is None else list(e.items()) for e in extra], arrow.field("_extra").type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    # what a file calls fps and robot_type now: top-level fields by their origin
    named_top = roots.filter("origin in ('fps', 'robot_type')")
    asked = place.filter("repo_id is not null and file_index is not null").withColumn("origin", F.explode(F.array(F.lit("fps"), F.lit("robot_type"))))
    asked = lookup_join(asked, named_top.select("repo_id", "origin").distinct(), ["repo_id", "origin"], "left_semi")
    top = last_before(asked, named_top, ["repo_id", "origin"], "name").groupBy("file_id").agg(F.max(F.when(F.col("origin") == "fps", F.col("name"))).alias("fps_name"), F.max(F.when(F.col("origin") == "robot_type", F.col("name"))).alias("robot_name"))
    told = known.join(top, ["file_id"], "left").withColumn("j", F.from_json("info", "map<string,string>", {"mode": "PERMISSIVE"}))
    told = told.select("file_id", F.coalesce(F.expr("try_element_at(j, coalesce(fps_name, 'fps'))"), F.expr("try_element_at(j, 'fps')")).alias("fps"), F.coalesce(F.expr("try_element_at(j, coalesce(robot_name, 'robot_type'))"), F.expr("try_element_at(j, 'robot_type')")).alias("robot_type"))
    maps = projections.filter("key <> field").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "field"))).alias("names"))  # a file's own keys
    per_file = place.groupBy("file_id").agg(F.min(F.struct("repo_id", "file_index")).alias("p")).select("file_id", "p.repo_id", "p.file_index").join(maps, ["file_id"], "left").join(told.groupBy("file_id").agg(F.max("fps").alias("fps"), F.max("robot_type").alias("robot_type")), ["file_id"], "left")
    table = hot_join(rows, per_file, ["file_id"], "left").select("record_id", "file_id", "repo_id", "file_index", "fps", "robot_type", "record", "names").mapInArrow(project, schema)
    listed = files.sparkSession.createDataFrame([(f, n, t) for f, n, t in catalog] or [], "field string, column string, type string")
    return Unified(table, fields.join(listed, ["field"], "left").select("field", "column", "type", "kinds", "files", "renamed_in"), projections)
