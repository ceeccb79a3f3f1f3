"""Sequence operators inside an episode, ordered by frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.functions import arrays
from epistrata.operators.carry import known_around
from epistrata.operators.quantiles import exact_quantiles
from epistrata.runtime import Workspace, c, hot_join, with_one_row


def _episode(df: DataFrame) -> Window:
    """The window partition of a row: its episode, or its stretch of one."""
    return Window.partitionBy("episode_index", "stretch") if "stretch" in df.columns else Window.partitionBy("episode_index")


def by_frame(df: DataFrame | None = None) -> Window:
    return (Window.partitionBy("episode_index") if df is None else _episode(df)).orderBy("frame_index", "index")


def in_stretches(df: DataFrame, before: int, after: int, size: int = 100_000) -> DataFrame:
    """Frames cut into stretches of ``size`` rows of an episode, each with so many rows before and after it (``halo``).

    For datasets with episodes too long for a task: every operator here that looks a bounded number of rows back and ahead (offset_window,
    stream_offset_window, action_chunks, next_states, joint_velocity, tracking_errors) gives on stretches what it gives on episodes; drop_halo
    then leaves each frame once. Rows are ranked through counts by blocks of frame_index, so no step takes a whole episode into one task.
    """
    block = F.floor(F.col("frame_index") / size)
    rows = df.withColumn("__b", block)
    counts = rows.groupBy("episode_index", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("episode_index").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("episode_index", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__s"))
    key = F.coalesce(F.col("episode_index"), F.lit(-(2**62)))
    rank = F.row_number().over(Window.partitionBy("episode_index", "__b").orderBy("frame_index", "index")) - 1
    near = rows.withColumn("__r", rank).withColumn("__k", F.xxhash64(key, F.coalesce("__b", F.lit(-1))))
    near = hot_join(near, starts.select(F.xxhash64(key, F.coalesce("__b", F.lit(-1))).alias("__k"), F.col("__s")), ["__k"])
    pos = F.col("__s") + F.col("__r")
    own, off = F.floor(pos / size), F.pmod(pos, F.lit(size))
    parts = F.filter(F.array(own, F.when((own > 0) & (off < after), own - 1), F.when(off >= size - before, own + 1)), lambda x: x.isNotNull())
    out = near.withColumn("__o", own).withColumn("stretch", F.explode(parts)).withColumn("halo", F.col("stretch") != F.col("__o"))
    return out.select(*[c(n) for n in df.columns], "stretch", "halo")


def drop_halo(df: DataFrame) -> DataFrame:
    """Each frame once, in its own stretch."""
    return df.filter(~F.col("halo")).drop("stretch", "halo")


# --- offsets ---


def delta_offsets(seconds: Sequence[float], fps: int, tolerance: float = 1e-4) -> list[int]:
    """Frame offsets of times; a time off the grid by more than the tolerance is an error."""
    if bad := [s for s in seconds if abs(round(s * fps) / fps - s) > tolerance]:
        raise ValueError(f"not on the grid of {fps} a second: {bad}")
    return [round(s * fps) for s in seconds]


def resolve_deltas(features: Sequence[str], action: Sequence[int] | None, observation: Sequence[int] | None, reward: Sequence[int] | None, fps: int) -> dict[str, list[float]]:
    """Times per feature from a model's offsets; features without offsets are left out."""
    out = {}
    for f in features:
        which = reward if f == "next.reward" else action if f.startswith("action") else observation if f.startswith("observation.") else None
        if which is not None:
            out[f] = [i / fps for i in which]
    return out


def offset_window(df: DataFrame, column: str, offsets: Sequence[int]) -> DataFrame:
    """Adds ``<column>_window`` and ``<column>_is_pad``: the values at offsets, beyond the episode those of its first or last frame and flagged.

    Each offset is a lag or lead, with the partition's first or last value as the stand-in.
    """
    w = by_frame(df)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row, n = F.row_number().over(w), F.count(F.lit(1)).over(_episode(df))
    values, pads = [], []
    for d in offsets:
        out = (row + d < 1) | (row + d > n)
        edge = F.first(c(column)).over(whole) if d < 0 else F.last(c(column)).over(whole)
        values.append(F.when(out, edge).otherwise(F.lead(c(column), d).over(w) if d else c(column)))
        pads.append(out)
    return df.select("*", F.array(*values).alias(f"{column}_window"), F.array(*pads).alias(f"{column}_is_pad"))


def stream_offset_window(df: DataFrame, column: str, offsets: Sequence[int], reach: int = 100) -> DataFrame:
    """The streaming reader's rule: beyond the episode or the buffer an offset repeats the farthest requested frame that was read, and so do all beyond it.

    With offsets [-10] at frame 5 that is frame 5 itself, where offset_window gives frame 0.
    """
    w = by_frame(df)
    row, n = F.row_number().over(w), F.count(F.lit(1)).over(_episode(df))
    got: dict[int, tuple[Column, Column]] = {0: (c(column), F.lit(False))}
    for side in (sorted((d for d in offsets if d < 0), reverse=True), sorted(d for d in offsets if d > 0)):
        last: Column = c(column)
        for d in side:
            ok = (row + d >= 1) & (row + d <= n) & F.lit(abs(d) <= reach)
            last = F.when(ok, F.lead(c(column), d).over(w)).otherwise(last)
            got[d] = (last, ~ok)
    return df.select("*", F.array(*[got[d][0] for d in offsets]).alias(f"{column}_window"), F.array(*[got[d][1] for d in offsets]).alias(f"{column}_is_pad"))


def bidirectional_indices(frame: Column, start: Column, end: Column, n_steps: int, gap: int) -> tuple[Column, Column]:
    """(indices, out-of-bounds flags) of n_steps + 1 frames around one, clamped to the episode."""
    half = n_steps // 2
    ds = [gap * i for i in range(-half, half + 1)]
    clamp = [F.greatest(start, F.least(end - 1, frame + d)) for d in ds]
    return F.array(*clamp), F.array(*[(x != frame + d).cast("int") for x, d in zip(clamp, ds)])


def rewind_indices(frame: Column, start: Column, n_steps: int, most: int, gap: int, step: Column) -> Column:
    """Frames going back before the earliest observed one, ``step`` of them or as many as there are."""
    earliest = frame - (n_steps // 2) * gap
    room = F.when(earliest > start, F.floor((earliest - start) / gap)).otherwise(0)
    k = F.least(step, F.lit(most), room).cast("int")
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.greatest(start, earliest - i * gap))).otherwise(F.array().cast("array<bigint>"))


def action_chunks(df: DataFrame, horizon: int, column: str = "action") -> DataFrame:
    """Rows that start a chunk of ``horizon`` consecutive actions, with ``chunk``; shorter episodes give none."""
    w = by_frame(df)
    chunk = F.array(*[F.lead(c(column), i).over(w) if i else c(column) for i in range(horizon)])
    room = F.count(F.lit(1)).over(_episode(df)) - F.row_number().over(w) + 1
    return df.select("*", chunk.alias("chunk"), room.alias("__room")).filter(F.col("__room") >= horizon).drop("__room")


def relative_chunks(chunk: Column, state: Column, which: Sequence[int], dims: int) -> Column:
    """Every action of the chunk less the state on some dimensions."""
    return F.transform(chunk, lambda a: arrays.subtract_dims(a, state, which, dims))


def next_states(df: DataFrame, column: str = "state", done: str | None = None) -> DataFrame:
    """Adds ``done`` (the episode's last frame unless given) and ``next_<column>``: that of the next frame, its own where done."""
    w = by_frame(df)
    last = F.lead("index").over(w).isNull()
    d = last if done is None else F.coalesce(c(done).cast("boolean"), F.lit(False)) | last
    return df.select("*", d.alias("done"), F.when(d, c(column)).otherwise(F.lead(c(column)).over(w)).alias(f"next_{column}"))


def joint_velocity(df: DataFrame, dt: float, dims: int, column: str = "state") -> DataFrame:
    """Adds ``<column>_v``: the vector with its finite differences over dt behind it; zeros at an episode's start."""
    prev = F.lag(c(column)).over(by_frame(df))
    v = [F.when(prev.isNull(), 0.0).otherwise((arrays.at(c(column), i) - arrays.at(prev, i)) / dt) for i in range(dims)]
    return df.select("*", F.array(*arrays.dims(c(column), dims), *v).alias(f"{column}_v"))


# --- tracking ---


def tracking_errors(df: DataFrame, lags: Sequence[int], arms: dict[str, tuple[Sequence[int], Sequence[int]]], command: str = "action", state: str = "state", least: float = 0.0, cumulative: bool = False) -> DataFrame:
    """(episode_index, frame_index, arm, lag, norms): what the arm moved over each number of frames against what was commanded.

    arms: name -> (state dimensions, action dimensions), the first three positions. ``cumulative`` sums the commands of the frames in between.
    All lags come from one sort of each episode.
    """
    w = by_frame(df)
    states, commands = sorted({i for s, _ in arms.values() for i in s}), sorted({i for _, a in arms.values() for i in a})
    # plain numbers instead of vectors keep the expressions small enough for generated code
    keys = [k for k in ("episode_index", "stretch", "halo", "frame_index", "index") if k in df.columns]
    rows = df.select(*keys, *[arrays.at(c(state), i).alias(f"s{i}") for i in states], *[arrays.at(c(command), i).alias(f"a{i}") for i in commands])
    ahead = [F.lead(f"s{i}", lag).over(w).alias(f"n{lag}_{i}") for lag in lags for i in states]
    ahead += [F.lead("index", lag).over(w).isNotNull().alias(f"has{lag}") for lag in lags]
    if cumulative:
        ahead += [F.sum(f"a{i}").over(w.rowsBetween(0, lag - 1)).alias(f"c{lag}_{i}") for lag in lags for i in commands]
    rows = rows.select("*", *ahead)
    norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    out = []
    for lag in lags:
        for arm, (s_dims, a_dims) in arms.items():
            moved = [F.col(f"n{lag}_{i}") - F.col(f"s{i}") for i in s_dims]
            told = [F.col(f"c{lag}_{i}" if cumulative else f"a{i}") for i in a_dims]
            err = [m - a for m, a in zip(moved, told)]
            norms = F.struct(F.lit(lag).alias("lag"), F.lit(arm).alias("arm"), norm(told[:3]).alias("command_norm_xyz"), norm(moved[:3]).alias("actual_norm_xyz"), norm(err[:3]).alias("error_norm_xyz"), norm(err[3:]).alias("error_norm_rot"))
            out.append(F.when(F.col(f"has{lag}"), norms))
    kept = [k for k in keys if k != "index"]
    flat = rows.select(*kept, F.explode(F.array(*out)).alias("e")).filter("e is not null").select(*kept, "e.*")
    return flat.filter(F.col("command_norm_xyz") >= least)


def tracking_sweep(df: DataFrame, lags: Sequence[int], arms: dict[str, tuple[Sequence[int], Sequence[int]]], least: float = 0.0, cumulative: bool = False) -> DataFrame:
    """Error statistics per arm and lag (or window of summed commands)."""
    rows = Workspace(df.sparkSession, "tracking").save(tracking_errors(df, lags, arms, least=least, cumulative=cumulative).drop("episode_index", "frame_index"), "errors")
    means = rows.groupBy("arm", "lag").agg(F.count(F.lit(1)).alias("steps"), F.avg("command_norm_xyz").alias("command_mean"), F.avg("actual_norm_xyz").alias("actual_mean"), F.avg("error_norm_xyz").alias("error_mean"), F.avg("error_norm_rot").alias("rotation_mean"))
    q = exact_quantiles(rows, ["arm", "lag"], "error_norm_xyz", [0.5, 0.95])
    return means.join(q, ["arm", "lag"]).withColumn("error_median", F.get("q", F.lit(0))).withColumn("error_p95", F.get("q", F.lit(1))).drop("q")


# --- binary signals ---


def debounced(signal: np.ndarray, least: int) -> np.ndarray:
    """Runs shorter than ``least`` taken over by the run before them (by the one after at the start), again and again until nothing changes.

    A round goes over the runs as they were at its start, from the left, with values as they are then.
    """
    s = np.asarray(signal, bool).copy()
    if s.size == 0 or least <= 1:
        return s
    while True:
        begin = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [s.size]])
        changed = False
        for k, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
            if b - a < least and begin.size > 2:
                s[a:b] = s[begin[k - 1]] if k else s[b]
                changed = True
        if not changed:
            return s


def debounce(df: DataFrame, signal: Column, least: int) -> DataFrame:
    """(episode_index, index, frame_index, on): the signal of each episode without short runs. The fixpoint is sequential, so it runs per episode in Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "index"])
        pdf["on"] = debounced(pdf["on"].to_numpy(bool), least)
        return pdf

    rows = df.select("episode_index", "index", "frame_index", F.coalesce(signal, F.lit(False)).alias("on"))
    return rows.groupBy("episode_index").applyInPandas(run, "episode_index long, index long, frame_index long, on boolean")


def first_cycle(df: DataFrame, buffer: int) -> DataFrame:
    """Per episode over (episode_index, frame_index, on): closes, releases, first_close, the first_release after it, and split = min(length, release + buffer); null without a release.

    ``on`` is open; frames are counted by position.
    """
    w = Window.partitionBy("episode_index").orderBy("frame_index", "index")
    pos = F.row_number().over(w) - 1
    prev = F.lag("on").over(w)
    edges = df.select("episode_index", pos.alias("pos"), (prev & ~F.col("on")).alias("close"), (~prev & F.col("on")).alias("release"))
    first = edges.withColumn("first_close", F.min(F.when(F.col("close"), F.col("pos"))).over(Window.partitionBy("episode_index")))
    out = first.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.count_if("close").alias("closes"), F.count_if("release").alias("releases"), F.first("first_close").alias("first_close"), F.min(F.when(F.col("release") & (F.col("pos") > F.col("first_close")), F.col("pos"))).alias("first_release"))
    return out.withColumn("split", F.when(F.col("first_release").isNotNull(), F.least(F.col("length"), F.col("first_release") + buffer)))


def cut_segments(df: DataFrame, splits: DataFrame, fps: float) -> DataFrame:
    """Each episode cut in two at ``split``: segment 0 and 1, with frame_index and timestamp from 0 again."""
    near = df.join(splits.filter("split is not null").select("episode_index", "split"), ["episode_index"])
    pos = F.row_number().over(by_frame()) - 1
    near = near.withColumn("__p", pos)
    seg = (F.col("__p") >= F.col("split")).cast("int")
    frame = F.col("__p") - F.when(seg == 1, F.col("split")).otherwise(0)
    return near.select("episode_index", seg.alias("segment"), "index", frame.cast("long").alias("frame_index"), (frame / fps).alias("timestamp"))


# --- interpolation, stages, smoothing ---


def interpolate(df: DataFrame, column: str, order: str = "frame_index", cell: int = 8192) -> DataFrame:
    """Adds ``<column>_filled``: linear between known values of the episode, constant beyond them; null and NaN are not known.

    Windows run over cells of ``cell`` numbers of the order; known values are carried from cell to cell, so an episode of any length is split.
    """
    known = F.when(c(column).isNotNull() & ~F.isnan(c(column)), F.struct(c(order).alias("i"), c(column).cast("double").alias("p")))
    out = known_around(df, ["episode_index"], F.floor(c(order) / cell), [c(order), F.col("index")], known, "__lo", "__hi")
    a, b = F.col("__lo"), F.col("__hi")
    x = F.when(a.isNull(), b["p"]).when(b.isNull() | (a["i"] == b["i"]), a["p"]).otherwise(a["p"] + (b["p"] - a["p"]) * (c(order) - a["i"]) / F.when(b["i"] != a["i"], b["i"] - a["i"]))
    return out.withColumn(f"{column}_filled", x).drop("__lo", "__hi")


def stage_and_tau(frame: Column, length: Column, stages: Column, n_stages: int) -> Column:
    """Stage + progress in it. stages: array of struct(stage, start, end), ends inclusive, in order; null for none.

    The first match wins; a gap counts as the end of the stage before; before the first 0, after the last the top.
    """
    top = n_stages - 1 + 0.999
    if n_stages == 1:
        share = F.greatest(F.lit(0.0), frame / F.greatest(length - 1, F.lit(1)))
        return F.when(share >= 1.0, top).otherwise(share)
    hit = F.get(F.filter(stages, lambda s: (s["start"] <= frame) & (frame <= s["end"])), F.lit(0))
    before = F.get(F.reverse(F.filter(stages, lambda s: s["end"] < frame)), F.lit(0))
    span = hit["end"] - hit["start"]
    tau = F.when(span <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (frame - hit["start"]) / F.when(span > 0, span))))
    first, last = F.get(stages, F.lit(0)), F.element_at(stages, -1)
    raw = F.when(stages.isNull() | (F.size(stages) == 0) | (frame < first["start"]), 0.0).when(frame > last["end"], top).when(hit.isNotNull(), hit["stage"] + tau).otherwise(before["stage"] + 1.0)
    return F.when(raw >= n_stages, top).otherwise(raw)


def breakpoints(shares: Sequence[float]) -> list[float]:
    """Cumulative shares from 0 to 1."""
    total = sum(shares)
    parts = [s / total for s in shares] if total > 0 else list(shares)
    return [0.0, *[sum(parts[: i + 1]) for i in range(len(parts) - 1)], 1.0]


def normalized_stage(x: Column, points: Sequence[float]) -> Column:
    """Stage + progress mapped to [0, 1], piecewise linear through the breakpoints."""
    out = F.lit(1.0)
    for i in range(len(points) - 2, -1, -1):
        out = F.when(x < i + 1, points[i] + (x - i) * (points[i + 1] - points[i])).otherwise(out)
    return F.when(x < 0, 0.0).otherwise(F.least(F.lit(1.0), out))


def smoothing_weights(window: int) -> np.ndarray:
    """Rows of weights over ``window`` values: the cubic least-squares fit to them, at each of their places."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1, dtype=float), 4, increasing=True)
    return powers @ np.linalg.pinv(powers)


def smoothed(df: DataFrame, column: str, window: int) -> DataFrame:
    """(episode_index, index, value): Savitzky-Golay of order 3, with the fit to an episode's first and last window at its edges.

    The window is made odd and at least 5; one of at most 1 and series shorter than the window stay as they are. A row looks at most window - 1
    rows to either side, so all of it is lags and leads, and stretches with such a halo give the same.
    """
    rows = df.filter(c(column).isNotNull()).withColumn("__v", c(column).cast("double"))
    keys = ["episode_index", "index", *[n for n in ("stretch", "halo") if n in df.columns]]
    if window <= 1:
        return rows.select(*keys, F.col("__v").alias("value"))
    window = max(5, window | 1)
    half, weights = window // 2, smoothing_weights(window)
    w = by_frame(rows)
    row, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(_episode(rows))
    near = rows.select("*", row.alias("__p"), n.alias("__n"), *[F.lead("__v", d).over(w).alias(f"__v{d + window}") for d in range(1 - window, window)])
    fit = lambda k, first: sum((float(weights[k][j]) * F.col(f"__v{first + j + window}") for j in range(window)), F.lit(0.0))
    out = F.when(F.col("__n") < window, F.col("__v"))
    for k in range(half):
        out = out.when(F.col("__p") == k, fit(k, -k)).when(F.col("__n") - 1 - F.col("__p") == k, fit(window - 1 - k, k + 1 - window))
    return near.select(*keys, out.otherwise(fit(half, -half)).alias("value"))


def ensemble(chunks: DataFrame, coefficient: float, size: int) -> DataFrame:
    """(episode_index, step, dim, value): all chunk predictions for a step averaged with weights exp(-coefficient * age rank), the oldest 0.

    chunks: episode_index, step, chunk (array of vectors for step, step + 1, ...).
    """
    flat = chunks.select("episode_index", F.col("step").alias("made"), F.posexplode("chunk").alias("k", "a")).filter(F.col("k") < size)
    flat = flat.select("episode_index", "made", (F.col("made") + F.col("k")).alias("step"), F.posexplode("a").alias("dim", "x"))
    w = Window.partitionBy("episode_index", "step", "dim").orderBy("made")
    aged = flat.withColumn("w", F.exp(-F.lit(coefficient) * (F.row_number().over(w) - 1)))
    return aged.groupBy("episode_index", "step", "dim").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("value"))


def prefix_weights(start: int, end: int, total: int, schedule: str) -> list[float]:
    """Weights of a chunk's steps: 1 up to ``start``, 0 from ``end``, in between zeros, ones, a linear or an exponential ramp."""
    start = min(start, end)
    if schedule == "zeros":
        return [1.0 if i < start else 0.0 for i in range(total)]
    if schedule == "ones":
        return [1.0 if i < end else 0.0 for i in range(total)]
    n = min(end, total) - start
    ramp = [1.0 - (i + 1) / (n + 1) for i in range(max(0, n))]
    if schedule == "exp":
        ramp = [r * math.expm1(r) / (math.e - 1) for r in ramp]
    return ([1.0] * min(start, total) + ramp + [0.0] * total)[:total]


# --- rollouts ---


def until_first_done(df: DataFrame, done: str = "done") -> DataFrame:
    """Rows up to one step past the first done. Where nothing is ever done the first done counts as step 0, so two rows are left."""
    first = F.min(F.when(c(done), F.col("frame_index"))).over(Window.partitionBy("episode_index"))
    return df.withColumn("__d", F.coalesce(first, F.lit(0))).filter(F.col("frame_index") <= F.col("__d") + 1).drop("__d")


def running_done(df: DataFrame, most: int, done: str = "done") -> DataFrame:
    """Adds ``over``: done now or before, or at the last step allowed."""
    w = by_frame().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("over", (F.max(c(done).cast("int")).over(w) == 1) | (F.col("frame_index") >= most - 1))


def rollout_frames(rollouts: DataFrame, fps: float) -> DataFrame:
    """(episode_index, frame_index, timestamp, action) from one row a rollout of ``actions`` and ``done_step``: cut after done, the last row once more."""
    n = F.least(F.size("actions"), F.col("done_step") + 1)
    kept = F.slice("actions", 1, n)
    flat = rollouts.select("episode_index", F.posexplode(F.concat(kept, F.slice(kept, -1, 1))).alias("frame_index", "action"))
    return flat.select("episode_index", F.col("frame_index").cast("long").alias("frame_index"), (F.col("frame_index") / fps).alias("timestamp"), "action")


def transitions_to_episodes(df: DataFrame, order: str = "seq", key: str = "stream") -> DataFrame:
    """Adds episode_no and frame_no: a new episode after each done or truncated row, the rest the last one. One window per stream."""
    w = Window.partitionBy(key).orderBy(order)
    end = (F.coalesce("done", F.lit(False)) | F.coalesce("truncated", F.lit(False))).cast("int")
    ep = F.coalesce(F.sum(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("episode_no", ep)
    return out.withColumn("frame_no", F.row_number().over(Window.partitionBy(key, "episode_no").orderBy(order)) - 1)


def boundary_rows(df: DataFrame) -> DataFrame:
    """First and last index of each episode."""
    return df.groupBy("episode_index").agg(F.min_by("index", F.struct("frame_index", "index")).alias("first_index"), F.max_by("index", F.struct("frame_index", "index")).alias("last_index"))


def value_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.filter(c(column).isNotNull() & ~F.isnan(c(column))).groupBy("episode_index").agg(F.min(c(column)).alias("low"), F.max(c(column)).alias("high"))


def trimmed_frames(df: DataFrame, first: int = 0, last: int = 0, episodes: Sequence[int] | None = None) -> DataFrame:
    """Frames without the first and last few of each episode, of some episodes only if asked."""
    w = by_frame()
    pos = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    out = df if episodes is None else df.filter(F.col("episode_index").isin(list(episodes)))
    return out.withColumn("__p", pos).withColumn("__n", n).filter((F.col("__p") > first) & (F.col("__p") <= F.col("__n") - last)).drop("__p", "__n")


def sampler_weights(df: DataFrame, online: Column, ratio: float, drop_last_offline: int = 0, drop_last_online: int = 0) -> DataFrame:
    """(index, weight): uniform inside each source by its ratio, 0 for the last frames of an episode, summing to 1; all 0 gives equal weights."""
    w = by_frame()
    left = F.count(F.lit(1)).over(Window.partitionBy("episode_index")) - F.row_number().over(w)
    flagged = df.select("index", "episode_index", "frame_index", online.alias("online")).withColumn("keep", left >= F.when(F.col("online"), drop_last_online).otherwise(drop_last_offline))
    sizes = flagged.agg(F.count_if(F.col("keep") & F.col("online")).alias("on"), F.count_if(F.col("keep") & ~F.col("online")).alias("off"), F.count(F.lit(1)).alias("n"))
    near = with_one_row(flagged, sizes)
    raw = F.when(~F.col("keep"), 0.0).when(F.col("online"), F.try_divide(F.lit(ratio), F.col("on"))).otherwise(F.try_divide(F.lit(1.0 - ratio), F.col("off")))
    total = F.when(F.col("on") > 0, ratio).otherwise(0.0) + F.when(F.col("off") > 0, 1.0 - ratio).otherwise(0.0)
    return near.select("index", F.when(total > 0, F.coalesce(raw, F.lit(0.0)) / F.when(total > 0, total)).otherwise(1.0 / F.col("n")).alias("weight"))


def latched(df: DataFrame, enabled: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the value at the last rising edge of ``enabled``, held until the next."""
    w = by_frame()
    rise = c(enabled) & ~F.coalesce(F.lag(c(enabled)).over(w), F.lit(False))
    return df.withColumn("__r", F.when(rise, value)).withColumn(name, F.last("__r", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__r")


def bounded_steps(df: DataFrame, column: str, low: Sequence[float], high: Sequence[float], jump: float) -> DataFrame:
    """Adds ``clipped`` (to a box) and ``jumps``: whether it is farther than ``jump`` from the frame before."""
    box = F.array(*[arrays.clip(arrays.at(c(column), i), a, b) for i, (a, b) in enumerate(zip(low, high))])
    out = df.withColumn("clipped", box)
    prev = F.lag("clipped").over(by_frame())
    far = F.sqrt(sum(((arrays.at(F.col("clipped"), i) - arrays.at(prev, i)) ** 2 for i in range(len(low))), F.lit(0.0)))
    return out.withColumn("jumps", F.coalesce(far > jump, F.lit(False)))
