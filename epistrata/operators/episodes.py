"""Editing of episodic datasets: filters, new keys, tasks, splits and unions. Episode tables are small beside frames; frames move only by episode."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.functions import arrays, text
from epistrata.runtime import c, lookup_join

REQUIRED = ("timestamp", "frame_index", "episode_index", "index", "task_index")


# --- filters and columns ---


def drop_episodes(frames: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Frames of all other episodes. An empty list is an error; null episodes stay."""
    if not ids:
        raise ValueError("no episodes to delete")
    return frames.filter(F.coalesce(~F.col("episode_index").isin(list(ids)), F.lit(True)))


def check_episodes(episodes: DataFrame, ids: Sequence[int]) -> None:
    """Raise if some of the ids are no episodes, or if they are all of them."""
    spark = episodes.sparkSession
    asked = spark.createDataFrame([(int(i),) for i in ids], "episode_index long")
    unknown = [r[0] for r in asked.join(episodes.select("episode_index").distinct(), ["episode_index"], "left_anti").orderBy("episode_index").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown episodes: {unknown}")
    if not episodes.filter(~F.col("episode_index").isin(list(ids))).limit(1).count():
        raise ValueError("all episodes would be deleted")


def episode_range(frames: DataFrame, first: int, last: int) -> DataFrame:
    return frames.filter(F.col("episode_index").between(first, last))


def drop_still_frames(frames: DataFrame, which: Sequence[int], threshold: float | None = None, action: str = "action") -> DataFrame:
    """Frames whose action moves: some of the dimensions not exactly 0, or with a threshold, the largest above it. Null actions go."""
    sizes = [F.abs(arrays.at(c(action), i)) for i in which]
    moves = F.lit(False)
    for s in sizes:
        moves = moves | (F.coalesce(s, F.lit(0.0)) > (threshold or 0.0))
    return frames.filter(moves)


def motion_at_least(frames: DataFrame, which: Sequence[int], least: float, action: str = "action") -> DataFrame:
    return frames.withColumn("motion", arrays.norm(c(action), which)).filter(F.col("motion") >= least)


def removed_summary(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Per episode total, kept and removed frames; an episode with kept = 0 was emptied."""
    k = kept.groupBy("episode_index").agg(F.count(F.lit(1)).alias("kept"))
    t = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("total"))
    return t.join(k, ["episode_index"], "left").select("episode_index", "total", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("removed"))


def matching_columns(df: DataFrame, patterns: Sequence[str], prefixes: Sequence[str] = ()) -> list[str]:
    """Names of columns that match any of the patterns once a known prefix is off."""
    import re

    out = []
    for name in df.columns:
        bare = next((name[len(p) :] for p in prefixes if name.startswith(p)), name)
        if any(re.search(p, bare) for p in patterns):
            out.append(name)
    return out


def remove_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without these columns; required and unknown ones are an error."""
    if bad := [n for n in names if n in REQUIRED]:
        raise ValueError(f"required: {bad}")
    if bad := [n for n in names if n not in df.columns]:
        raise ValueError(f"unknown: {bad}")
    gone = set(names)
    return df.select(*[c(n) for n in df.columns if n not in gone])


def modify_features(df: DataFrame, add: dict[str, Column] | None = None, remove: Sequence[str] = ()) -> DataFrame:
    """Add and remove columns in one projection; nothing to do and names that exist are errors."""
    if not add and not remove:
        raise ValueError("nothing to add or remove")
    if bad := [n for n in add or {} if n in df.columns]:
        raise ValueError(f"exist already: {bad}")
    kept = remove_features(df, remove) if remove else df
    return kept.select("*", *[x.alias(n) for n, x in (add or {}).items()])


def add_by_index(df: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add columns of another table by ``index``; null where it has none."""
    return df.join(values.select("index", *[c(n) for n in names]), ["index"], "left")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[c(n).alias(names.get(n, n)) for n in df.columns])


def pack(df: DataFrame, names: Sequence[str], to: str) -> DataFrame:
    """Scalars into one vector in the declared order."""
    return df.withColumn(to, F.array(*[c(n).cast("float") for n in names]))


def unpack(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """A vector into named scalars."""
    return df.select("*", *[F.get(c(vector), F.lit(i)).alias(n) for i, n in enumerate(names)])


def to_transition(df: DataFrame) -> DataFrame:
    """Flat frames as one struct ``t`` with observation, action, reward, done, truncated, complementary_data; reward 0.0 and flags false where absent."""
    has = lambda n, x: c(n) if n in df.columns else x
    group = lambda p: F.struct(*[c(n).alias(n.removeprefix(p)) for n in df.columns if n.startswith(p)]) if any(n.startswith(p) for n in df.columns) else F.lit(None)
    return df.select("index", F.struct(
        group("observation.").alias("observation"), has("action", F.lit(None)).alias("action"), F.coalesce(has("next.reward", F.lit(None)).cast("double"), F.lit(0.0)).alias("reward"),
        F.coalesce(has("next.done", F.lit(None)).cast("boolean"), F.lit(False)).alias("done"), F.coalesce(has("next.truncated", F.lit(None)).cast("boolean"), F.lit(False)).alias("truncated"), group("complementary_info.").alias("complementary_data"),
    ).alias("t"))


def from_transition(df: DataFrame) -> DataFrame:
    """The flat frames of to_transition."""
    t = df.schema["t"].dataType
    out = [F.col("index")]
    for f in t.fields:
        prefix = {"observation": "observation.", "complementary_data": "complementary_info."}.get(f.name)
        if prefix and hasattr(f.dataType, "fields"):
            out += [F.col("t")[f.name][g.name].alias(prefix + g.name) for g in f.dataType.fields]
        elif f.name in ("reward", "done", "truncated"):
            out.append(F.col("t")[f.name].alias(f"next.{f.name}"))
        elif f.name == "action":
            out.append(F.col("t")["action"].alias("action"))
    return df.select(*out)


def patch_features(df: DataFrame, defaults: dict[str, tuple[str, int]]) -> DataFrame:
    """Add missing columns as zeros: name -> (element type, width); width 1 is a scalar."""
    new = [(F.lit(0).cast(t) if w == 1 else F.array_repeat(F.lit(0).cast(t), w)).alias(n) for n, (t, w) in defaults.items() if n not in df.columns]
    return df.select("*", *new)


def convert_legacy(df: DataFrame, widths: dict[str, int], drop: Sequence[str] = (), zeros: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Vectors to float of a checked width, some columns dropped, missing ones as zeros."""
    out = []
    for n in df.columns:
        if n in widths:
            ok = F.assert_true(F.size(c(n)) == widths[n], F.concat(F.lit(f"{n} must have {widths[n]} values, not "), F.size(c(n)).cast("string")))
            out.append(F.when(ok.isNull(), c(n).cast("array<float>")).alias(n))
        elif n not in set(drop):
            out.append(c(n))
    return patch_features(df.select(*out), zeros or {})


def label_success(episodes: DataFrame, success: Sequence[int] = (), failure: Sequence[int] = (), default: str | None = None, field: str = "episode_success", overwrite: bool = False) -> DataFrame:
    """Outcome per episode by explicit lists and a default; an episode in both lists, and a label that exists, are errors."""
    if both := set(success) & set(failure):
        raise ValueError(f"in both lists: {sorted(both)}")
    if field in episodes.columns and not overwrite:
        raise ValueError(f"{field} exists")
    e = F.col("episode_index")
    label = F.when(e.isin(list(success)), "success").when(e.isin(list(failure)), "failure").otherwise(F.lit(default))
    return episodes.withColumn(field, label)


def resolved_label(label: Column, default: str | None = None) -> Column:
    """Explicit label, else the default; anything but success and failure raises."""
    x = F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit(default))
    ok = F.assert_true(x.isNull() | x.isin("success", "failure"), F.concat(F.lit("no outcome: "), x))
    return F.when(ok.isNull(), x)


def collector(intervention_enabled: Column, intervention: Column, from_policy: Column, policy: Column, human: Column) -> Column:
    """Who collected a frame: without interventions the policy if it drove, with them the human while intervening."""
    return F.when(intervention_enabled, F.when(intervention, human).otherwise(policy)).otherwise(F.when(from_policy, policy).otherwise(human))


def next_version(names: DataFrame, stem: str, day: str, column: str = "name") -> DataFrame:
    """The next ``stem_YYYYMMDD_vNN`` after those among the names."""
    n = F.regexp_extract(c(column), rf"^{stem}_{day}_v(\d+)$", 1)
    return names.agg(F.coalesce(F.max(F.nullif(n, F.lit("")).cast("int")), F.lit(0)).alias("n")).select(F.format_string(f"{stem}_{day}_v%02d", (F.col("n") + 1).cast("int")).alias("version"))


# --- keys ---


def dense_episodes(episodes: DataFrame) -> DataFrame:
    """episode_index, new_index (dense, in the old order), from_index, to_index by running lengths.

    The ranks come from range partitions and their sizes, so no task sees the whole episode table.
    """
    e = episodes.select("episode_index", F.col("length").cast("long").alias("length")).filter("episode_index is not null")
    parts = e.repartitionByRange("episode_index").withColumn("p", F.spark_partition_id())
    from epistrata.runtime import Workspace

    parts = Workspace(episodes.sparkSession, "dense").save(parts, "parts")
    sums = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l"))  # one row a partition
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("l").over(w), F.lit(0)).alias("l0"))
    inside = Window.partitionBy("p").orderBy("episode_index")
    out = parts.withColumn("r", F.row_number().over(inside) - 1).withColumn("s", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(F.broadcast(base), ["p"])
    return out.select("episode_index", (F.col("n0") + F.col("r")).cast("long").alias("new_index"), (F.col("l0") + F.col("s") - F.col("length")).alias("from_index"), (F.col("l0") + F.col("s")).alias("to_index"), "length")


def reindex(frames: DataFrame, order: str = "frame_index", keys: DataFrame | None = None) -> DataFrame:
    """Frames under dense new keys: episode_index in the old order, frame order kept, ``index`` dense over the dataset.

    Adds old_episode_index. Lengths are counted from the frames; offsets come from ``keys`` (dense_episodes of the episodes wanted, by default of all that have
    frames), never from a window over all frames. Frames are ranked in stretches, so a long episode is many tasks' work.
    """
    if keys is None:
        keys = dense_episodes(frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")))
    w = Window.partitionBy("episode_index").orderBy(order, "index")
    ranked = frames.filter("episode_index is not null").withColumn("__r", F.row_number().over(w) - 1)
    out = lookup_join(ranked, keys.select("episode_index", "new_index", "from_index"), ["episode_index"])
    names = [c(n) for n in frames.columns if n not in ("episode_index", "index")]
    return out.select(F.col("episode_index").alias("old_episode_index"), F.col("new_index").alias("episode_index"), (F.col("from_index") + F.col("__r")).alias("index"), *names)


def video_spans(episodes: DataFrame, kept: DataFrame, fps: str = "fps") -> DataFrame:
    """New from and to of each kept episode (a table of episode_index) in its video file: unchanged if all of a file's episodes stay, else restarted and accumulated by length / fps."""
    keep = F.col("__keep").isNotNull()
    per_file = Window.partitionBy("chunk_index", "file_index")
    e = episodes.join(kept.select("episode_index", F.lit(True).alias("__keep")).distinct(), ["episode_index"], "left").withColumn("whole", F.min(F.when(keep, 1).otherwise(0)).over(per_file) == 1).filter(keep)
    run = per_file.orderBy("episode_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = F.col("length") / F.col(fps)
    upto = F.sum(seconds).over(run)
    return e.select("episode_index", F.when(F.col("whole"), F.col("from_timestamp")).otherwise(upto - seconds).alias("from_timestamp"), F.when(F.col("whole"), F.col("to_timestamp")).otherwise(upto).alias("to_timestamp"))


def ring_keep(frames: DataFrame, capacity: int, size: int) -> DataFrame:
    """What a first-in first-out buffer of ``capacity`` holds after ``size`` rows of dense index, with their slots."""
    return frames.filter(F.col("index") >= size - capacity).withColumn("slot", F.pmod("index", F.lit(capacity)))


def shift_after(last_index: int, last_episode: int, incoming: DataFrame) -> DataFrame:
    """Incoming keys moved to follow the last row."""
    return incoming.withColumn("index", F.col("index") + (last_index + 1)).withColumn("episode_index", F.col("episode_index") + (last_episode + 1))


# --- tasks ---


def upsert_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """The tasks with unseen texts appended under the next ids, in order of text."""
    top = tasks.agg(F.coalesce(F.max("task_index"), F.lit(-1)).alias("m")).first()["m"]
    fresh = new.select("task").filter("task is not null").distinct().join(tasks.select("task"), ["task"], "left_anti")
    w = Window.orderBy("task")  # unseen task texts: a catalogue
    return tasks.select("task", "task_index").unionByName(fresh.select("task", (F.row_number().over(w) + top).cast("long").alias("task_index")))


def retask(episodes: DataFrame, default: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(episode_index, task, task_index): override, else default, else the first task; ids by sorted text."""
    e = episodes.select("episode_index", F.get("tasks", F.lit(0)).alias("first"))
    if overrides is not None:
        e = e.join(overrides.select("episode_index", F.col("task").alias("own")), ["episode_index"], "left")
    own = F.col("own") if overrides is not None else F.lit(None).cast("string")
    e = e.select("episode_index", F.coalesce(own, F.lit(default), F.col("first")).alias("task"))
    ids = e.select("task").filter("task is not null").distinct().select("task", (F.dense_rank().over(Window.orderBy("task")) - 1).cast("long").alias("task_index"))  # the catalogue of texts
    return lookup_join(e, ids, ["task"], "left").select("episode_index", "task", "task_index")


def rekey_tasks(frames: DataFrame, source: DataFrame, target: DataFrame, episode_offset: int = 0, index_offset: int = 0) -> DataFrame:
    """Frames with the target's id of their task's text, episode_index and index moved by the running totals."""
    to = source.select(F.col("task_index").alias("old"), "task").join(target.select("task", F.col("task_index").alias("new")), ["task"]).select(F.col("old").alias("task_index"), "new")
    out = lookup_join(frames, to, ["task_index"], "left")
    return out.withColumns({"task_index": F.col("new"), "episode_index": F.col("episode_index") + episode_offset, "index": F.col("index") + index_offset}).drop("new")


def first_seen_tasks(sources: DataFrame) -> DataFrame:
    """(task, task_index) over (source_no, task_index, task): distinct texts in order of first appearance."""
    first = sources.filter("task is not null").groupBy("task").agg(F.min(F.struct("source_no", "task_index")).alias("at"))
    return first.select("task", (F.row_number().over(Window.orderBy("at", "task")) - 1).cast("long").alias("task_index"))  # the catalogue of texts


def find_task(tasks: DataFrame, part: str) -> DataFrame:
    """The first task whose text contains the part, in any case."""
    return tasks.filter(F.instr(F.lower("task"), part.lower()) > 0).orderBy("task_index").limit(1)


# --- splits, samples, unions ---


def fraction_ranges(n: int, splits: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Contiguous episode ranges of int(n * f); the last named split takes the rest, unless its own share is 0; empty ones are left out."""
    if sum(splits.values()) > 1 + 1e-9:
        raise ValueError("fractions sum to more than 1")
    out, at = {}, 0
    names = list(splits)
    for name in names:
        size = int(n * splits[name])
        if size == 0:
            continue
        end = n if name == names[-1] else at + size
        out[name] = (at, end)
        at = end
    return out


def split_column(position: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, (a, b) in ranges.items():
        out = F.when((position >= a) & (position < b), name).otherwise(out)
    return out


def check_disjoint(splits: dict[str, Sequence[int]]) -> None:
    """Raise if two splits share an episode."""
    seen: dict[int, str] = {}
    for name, ids in splits.items():
        for i in ids:
            if seen.setdefault(i, name) != name:
                raise ValueError(f"episode {i} is in {seen[i]} and {name}")


def shard_of(index: Column, n: int, shards: int) -> Column:
    """Contiguous shard of a dense index: ceil(n / shards) rows each."""
    return F.floor(index / max(1, -(-n // shards))).cast("int")


def padded_shards(df: DataFrame, n: int, shards: int) -> DataFrame:
    """(shard, index) with the tail filled up by the last row, so all shards have one size; gather by distinct index."""
    size = max(1, -(-n // shards))
    rows = df.select(shard_of(F.col("index"), n, shards).alias("shard"), "index")
    extra = df.sparkSession.range(n, size * shards).select(F.floor(F.col("id") / size).cast("int").alias("shard"), F.lit(n - 1).cast("long").alias("index"))
    return rows.unionByName(extra)


def even_sample(n: int, least: int = 100, most: int = 10_000, power: float = 0.75) -> list[int]:
    """Evenly spaced row numbers, about n ** 0.75 of them within bounds, rounded half to even."""
    if n <= 0:
        return []
    k = max(min(least, n), min(int(n**power), most))
    return [0] if k == 1 else [int(round(i * (n - 1) / (k - 1))) for i in range(k)]


def even_sample_column(index: Column, n: int) -> Column:
    """Whether a dense index is in even_sample(n), without a list: some k rounds to it."""
    k = len(even_sample(n))
    if k <= 1:
        return index == 0
    step = (n - 1) / (k - 1)
    near = F.floor(index / step)
    hit = lambda j: (j >= 0) & (j < k) & (F.rint(j * (n - 1) / float(k - 1)) == index)
    return hit(near) | hit(near + 1) | hit(near - 1)


def hash_sample(df: DataFrame, group: str, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """max(1, int(n * fraction)) rows of each group without replacement, in order of a seeded hash."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(text.hash_number(*[c(k) for k in key], seed=seed), *[c(k) for k in key])))
    return ranked.filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))).drop("__n", "__r")


def weighted_subset(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement with chances by weight: the least -ln(u) / w."""
    u = (text.hash_number(c(key), seed=seed) + 0.5) / float(1 << 52)
    return df.filter(F.col(weight) > 0).withColumn("__k", -F.log(u) / F.col(weight)).orderBy("__k", key).limit(n).drop("__k")


def replay_sample(df: DataFrame, n: int, batch: int, seed: int) -> DataFrame:
    """``batch`` draws with replacement from a dense index 0 .. n - 1, by hash."""
    draws = df.sparkSession.range(min(batch, n)).select(F.col("id").alias("draw"), F.pmod(text.hash_number(F.col("id"), seed=seed), F.lit(n)).alias("index"))
    return df.join(draws, ["index"])


def union_checked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two datasets whose features must be the same."""
    a, b = {f.name: f.dataType for f in left.schema}, {f.name: f.dataType for f in right.schema}
    if a != b:
        raise ValueError(f"features differ: {sorted(set(a.items()) ^ set(b.items()), key=str)}")
    return left.unionByName(right)


def merge_datasets(parts: Sequence[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Frames and tasks of the union of (frames, episodes, tasks), keys moved by running totals and tasks re-keyed by text."""
    every = None
    for k, (_, _, t) in enumerate(parts):
        rows = t.select(F.lit(k).alias("source_no"), "task_index", "task")
        every = rows if every is None else every.unionByName(rows)
    target = first_seen_tasks(every)
    out, ep0, ix0 = None, 0, 0
    for f, e, t in parts:
        moved = rekey_tasks(f, t, target, ep0, ix0)
        out = moved if out is None else union_checked(out, moved)
        n = e.agg(F.max("episode_index").alias("e"), F.max("dataset_to_index").alias("i")).first()
        ep0, ix0 = ep0 + (n["e"] if n["e"] is not None else -1) + 1, ix0 + (n["i"] or 0)
    return out, target


def union_intersection(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows on the columns that all parts have, with dataset_index; none in common is an error."""
    common = [n for n in parts[0].columns if all(n in p.columns for p in parts)]
    if not common:
        raise ValueError("no column in common")
    out = None
    for k, p in enumerate(parts):
        rows = p.select(*[c(n) for n in common], F.lit(k).alias("dataset_index"))
        out = rows if out is None else out.unionByName(rows)
    return out


def union_transitions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, with null for the columns of the other."""
    return left.unionByName(right, allowMissingColumns=True)


def feature_gaps(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) names."""
    have = set(df.columns)
    return sorted(set(expected) - have), sorted(have - set(expected))


def missing_rows(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """Frames without a prediction."""
    return frames.select("index").join(predictions.select("index"), ["index"], "left_anti")


def destination_files(files: DataFrame, most: float, per_chunk: int = 1000, dataset: str = "dataset") -> DataFrame:
    """(dataset, file_no, dst_chunk, dst_file, offset) of each source file (dataset, file_no, size) in its dataset's order: appended while the sum stays below the limit, else a new file; offset is what is in it.

    A file starts where the sizes since the last start reach the limit, so all starts follow from running sums: each place points to the next start after it, found
    by binary search, and only starts are visited. One row a file of a dataset is one task's work: numbers, not data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_no")
        upto = np.concatenate([[0.0], np.cumsum(pdf["size"].to_numpy(float))])
        starts = [0]
        while True:
            nxt = max(int(np.searchsorted(upto, upto[starts[-1]] + most, "left")) - 1, starts[-1] + 1)
            if nxt >= len(pdf):
                break
            starts.append(nxt)
        at = np.searchsorted(starts, np.arange(len(pdf)), "right") - 1
        return pd.DataFrame({dataset: pdf[dataset], "file_no": pdf["file_no"], "dst_chunk": at // per_chunk, "dst_file": at % per_chunk, "offset": upto[:-1] - upto[np.array(starts)[at]]})

    kind = files.schema[dataset].dataType.simpleString()
    rows = files.select(c(dataset), F.col("file_no").cast("long").alias("file_no"), F.col("size").cast("double").alias("size"))
    return rows.groupBy(dataset).applyInPandas(run, f"`{dataset}` {kind}, file_no long, dst_chunk long, dst_file long, offset double")


def greedy_batches(sizes: Sequence[float], most: float, most_items: int) -> list[list[int]]:
    """Consecutive items packed while sum and number stay within limits; a batch holds at least one."""
    out: list[list[int]] = []
    used = 0.0
    for i, s in enumerate(sizes):
        if out and out[-1] and used + s <= most and len(out[-1]) < most_items:
            out[-1].append(i)
            used += s
        else:
            out.append([i])
            used = s
    return out


def parse_episode_spec(spec: str, total: int | None = None) -> list[tuple[int, int]]:
    """Ranges (first, last) of "all", "3" or "0-5,8", in order, joined where they touch; with a total, ids outside the dataset are an error. No list of ids is made."""
    if spec.strip().lower() == "all":
        return [(0, total - 1 if total is not None else (1 << 62))]
    pairs = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        pairs.append((int(a), int(b or a)))
    if total is not None and (bad := [f"{a}-{b}" for a, b in pairs if a < 0 or b >= total]):
        raise ValueError(f"outside 0..{total - 1}: {bad}")
    out: list[tuple[int, int]] = []
    for a, b in sorted(p for p in pairs if p[0] <= p[1]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_ranges(ranges: Sequence[tuple[int, int]], column: str = "episode_index") -> Column:
    """Whether a number lies in one of the ranges; a filter that scans can use."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | F.col(column).between(a, b)
    return out


def pick_camera(cameras: dict[str, tuple[int, int]]) -> str:
    """Front cameras first, then the most pixels, then the name."""
    return min(cameras, key=lambda k: ("front" not in k, -cameras[k][0] * cameras[k][1], k))
