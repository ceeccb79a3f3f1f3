"""Matching records by nearest time: a learned index over each entity's time shards, whose edges overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrata.runtime import Workspace, lookup_join

#: A segment of the index predicts a position to within so many places.
EPSILON = 16
#: Rows that a task matches at once.
CHUNK_ROWS = 200_000


class LearnedIndex:
    """Piecewise-linear model from time to position in an array sorted within shards.

    ``starts`` are the shards' first positions (with the length at the end). A segment is a straight line through
    its first and last point; a segment that errs by more than epsilon anywhere is halved, all of them at
    once, until none does. As the model rises with time, a time between two neighbours is also
    predicted to within epsilon of them.
    """

    def __init__(self, t: np.ndarray, starts: np.ndarray, epsilon: int = EPSILON):
        self.t, self.epsilon = t, epsilon
        lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64) - 1
        keep = hi >= lo
        lo, hi = lo[keep], hi[keep]
        done_lo, done_hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while lo.size:
            err = self._errors(lo, hi)
            bad = err > epsilon
            done_lo.append(lo[~bad])
            done_hi.append(hi[~bad])
            lo, hi = lo[bad], hi[bad]
            mid = (lo + hi) // 2
            lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        lo, hi = np.concatenate(done_lo), np.concatenate(done_hi)
        order = np.lexsort((hi, lo))
        self.lo, self.hi = lo[order], hi[order]
        self.first = np.searchsorted(self.lo, starts[:-1], "left")
        self.last = np.searchsorted(self.lo, starts[1:], "left")

    def _slope(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        span = self.t[hi] - self.t[lo]
        return np.divide((hi - lo).astype(float), span, out=np.zeros(lo.size), where=span > 0)

    def _errors(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo + 1
        at = np.repeat(np.arange(lo.size), n)
        pos = np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
        wrong = np.abs((self.t[lo[at] + pos] - self.t[lo][at]) * self._slope(lo, hi)[at] - pos)
        return np.maximum.reduceat(wrong, np.cumsum(n) - n)

    def right_of(self, q: np.ndarray, shard: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First position of the shard whose time is above q (the shard's end where there is none)."""
        a, b = self.first[shard].copy(), self.last[shard].copy()
        low, end = starts[shard].astype(np.int64), starts[shard + 1].astype(np.int64)
        out = end.copy()
        live = np.flatnonzero(b > a)
        a, b = a[live], b[live]
        x, lo0, end = q[live], low[live], end[live]
        while True:  # the last segment that starts at or before q
            wide = b - a > 1
            if not wide.any():
                break
            m = (a + b) // 2
            go = wide & (self.t[self.lo[np.minimum(m, self.lo.size - 1)]] <= x)
            a, b = np.where(go, m, a), np.where(wide & ~go, m, b)
        lo, hi = self.lo[a], self.hi[a]
        guess = np.clip((x - self.t[lo]) * self._slope(lo, hi), -1.0, (hi - lo) + 1.0)
        guess = lo + guess.astype(np.int64)
        left, right = np.maximum(lo0, guess - self.epsilon - 1), np.minimum(end, guess + self.epsilon + 3)
        while True:  # search in the few places where it can be
            wide = right > left
            if not wide.any():
                break
            m = (left + right) // 2
            go = wide & (self.t[np.minimum(m, self.t.size - 1)] <= x)
            left, right = np.where(go, m + 1, left), np.where(wide & ~go, m, right)
        out[live] = left
        return out


#: Rows of a sorted partition: found pairs, samples open at the partition's edge, and the edge frames.
FOUND, OPEN, EDGE = 0, 1, 2
WALKED = pa.schema([("what", pa.int8()), ("e", pa.int64()), ("t", pa.float64()), ("id", pa.int64()), ("tol", pa.float64()), ("index", pa.int64()), ("dt", pa.float64())])
_NONE = np.iinfo(np.int64).max


def better(d: np.ndarray, i: np.ndarray, other_d: np.ndarray, other_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearer of two candidates, on a tie the one of smaller index; no candidate has an infinite distance."""
    take = (other_d < d) | ((other_d == d) & (other_i < i))
    return np.where(take, other_d, d), np.where(take, other_i, i)


class Walk:
    """Matches the rows of a partition, sorted by entity, time, kind (frames first) and id, in chunks cut anywhere.

    A shard is what a chunk holds of an entity. The last frame before it goes on into the next chunk, and samples after its last
    frame wait for the next one, so shards overlap by one frame on either side whatever the tolerance.
    """

    def __init__(self) -> None:
        self.first_entity: int | None = None
        self.first_frame: float | None = None  # its time, of the first entity's first frame
        self.last_row: tuple | None = None
        self.carry: tuple[int, float, int] | None = None  # the last frame: entity, time, id
        self.edges: list[tuple[int, float, int]] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []  # t, id, tol, candidate's distance and index, whether the left side is open
        self.entity: int | None = None

    def _rows(self, e: np.ndarray, t: np.ndarray, ident: np.ndarray, tol: np.ndarray, d: np.ndarray, i: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
        keep = is_open | (d <= tol) & (i != _NONE)
        none = pa.array(i[keep] == _NONE)
        what = np.where(is_open[keep], OPEN, FOUND).astype(np.int8)
        index = pa.array(i[keep], mask=none.to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array(what), pa.array(e[keep]), pa.array(t[keep]), pa.array(ident[keep]), pa.array(tol[keep]), index, pa.array(d[keep])], schema=WALKED)

    def _settle(self, frame: tuple[float, int] | None, is_open: bool = False) -> Iterator[pa.RecordBatch]:
        """Samples that waited get the next frame of their entity, or none."""
        for t, ident, tol, d, i, left_open in self.waiting:
            if frame is not None:
                d, i = better(d, i, frame[0] - t, np.full(t.size, frame[1]))
            yield self._rows(np.full(t.size, self.entity), t, ident, tol, d, i, left_open | is_open)
        self.waiting = []

    def chunk(self, e: np.ndarray, t: np.ndarray, kind: np.ndarray, ident: np.ndarray, tol: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.zeros(e.size, bool)
        same[1:] = (e[1:] == e[:-1]) & (t[1:] == t[:-1]) & (kind[1:] == kind[:-1]) & (ident[1:] == ident[:-1])
        same[0] = self.last_row == (e[0], t[0], kind[0], ident[0])
        self.last_row = (e[-1], t[-1], kind[-1], ident[-1])
        if self.first_entity is None:
            self.first_entity = int(e[0])
        # frames, one a time (that of least index), after the one carried over
        at = np.flatnonzero(~same & (kind == 0))
        fe, ft, fi = e[at], t[at], ident[at]
        if self.carry and self.carry[0] == e[0]:
            fe, ft, fi = (np.concatenate([[c], x]) for c, x in zip(self.carry, (fe, ft, fi)))
        lone = np.ones(fe.size, bool)
        lone[1:] = (fe[1:] != fe[:-1]) | (ft[1:] != ft[:-1])
        fe, ft, fi = fe[lone].astype(np.int64), ft[lone], fi[lone].astype(np.int64)
        if self.first_frame is None and fe.size and fe[0] == self.first_entity:
            self.first_frame = float(ft[0])
            self.edges.append((int(fe[0]), float(ft[0]), int(fi[0])))
        if self.entity is not None and self.waiting:
            new = np.flatnonzero((fe == self.entity) & ((ft > self.carry[1]) if self.carry and self.carry[0] == self.entity else True))
            if new.size:
                yield from self._settle((float(ft[new[0]]), int(fi[new[0]])))
            elif e[-1] != self.entity:
                yield from self._settle(None)
        self.entity = int(e[-1])
        at = np.flatnonzero(~same & (kind == 1))
        if at.size:
            entities = np.unique(e)
            starts = np.concatenate([np.searchsorted(fe, entities, "left"), [fe.size]])
            q, which, qe = t[at], np.searchsorted(entities, e[at]), e[at]
            if fe.size:
                right = LearnedIndex(ft, starts).right_of(q, which, starts)
                left = right - 1
                has_l, has_r = left >= starts[which], right < starts[which + 1]
                l, r = np.maximum(left, 0), np.minimum(right, ft.size - 1)
                d, i = np.where(has_l, q - ft[l], np.inf), np.where(has_l, fi[l], _NONE)
                d, i = better(d, i, np.where(has_r, ft[r] - q, np.inf), np.where(has_r, fi[r], _NONE))
                left_time = np.where(has_l, ft[l], -np.inf)
            else:
                has_l = has_r = np.zeros(at.size, bool)
                d, i, left_time = np.full(at.size, np.inf), np.full(at.size, _NONE), np.full(at.size, -np.inf)
            # the partition before may hold a frame nearer on the left, or one of the same time and smaller index
            left_open = (qe == self.first_entity) & (~has_l | (left_time == (self.first_frame if self.first_frame is not None else np.nan)))
            wait = ~has_r & (qe == self.entity)
            if wait.any():
                self.waiting.append((q[wait], ident[at][wait], tol[at][wait], d[wait], i[wait], left_open[wait]))
            go = ~wait
            yield self._rows(qe[go], q[go], ident[at][go], tol[at][go], d[go], i[go], left_open[go])
        if fe.size and fe[-1] == self.entity:
            self.carry = (int(fe[-1]), float(ft[-1]), int(fi[-1]))
        elif self.carry and self.carry[0] != self.entity:
            self.carry = None

    def end(self) -> Iterator[pa.RecordBatch]:
        """The last entity may go on in the next partition: what waits is open, and its last frame is an edge."""
        if self.entity is None:
            return
        yield from self._settle(None, True)
        if self.carry and self.carry[0] == self.entity:
            self.edges.append(self.carry)
        n = len(self.edges)
        if n:
            e, t, i = zip(*self.edges)
            yield pa.RecordBatch.from_arrays([pa.array([EDGE] * n, pa.int8()), pa.array(e, pa.int64()), pa.array(t, pa.float64()), pa.array(i, pa.int64()), pa.array([0.0] * n), pa.nulls(n, pa.int64()), pa.array([0.0] * n)], schema=WALKED)


def _walk(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, kept, n = Walk(), [], 0

        def go() -> Iterator[pa.RecordBatch]:
            tab = pa.Table.from_batches(kept)
            yield from walk.chunk(*(tab.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("e", "t", "kind", "id", "tol")))

        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                kept.append(batch)
                n += batch.num_rows
                if n >= rows:
                    yield from go()
                    kept, n = [], 0
        if kept:
            yield from go()
        yield from walk.end()

    return run


def _resolve(edges: list[tuple[int, float, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Open samples against the edge frames of all partitions."""
    out = pa.schema([("sample_id", pa.int64()), ("index", pa.int64()), ("dt", pa.float64())])
    edges = sorted(edges)
    e, t, i = (np.array(x, k) for x, k in zip(zip(*edges) if edges else ((), (), ()), (np.int64, np.float64, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda k: b.column(k).to_numpy(zero_copy_only=False)
            qe, q, tol, d = col("e"), col("t"), col("tol"), col("dt")
            best = pa.array(b.column("index")).fill_null(_NONE).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(e, qe, "left"), np.searchsorted(e, qe, "right")
            low, high = first.copy(), last.copy()
            while (high > low).any():  # first edge of the entity after q
                live = high > low
                m = (low + high) // 2
                after = t[np.minimum(m, t.size - 1)] > q
                high, low = np.where(live & after, m, high), np.where(live & ~after, m + 1, low)
            for has, at in ((low < last, low), (low > first, low - 1)):
                at = np.clip(at, 0, max(0, t.size - 1))
                if t.size:
                    d, best = better(d, best, np.where(has, np.abs(q - t[at]), np.inf), np.where(has, i[at], _NONE))
            # of edges at one time on the left the one of least index
            while t.size:
                at = np.clip(low - 2, 0, t.size - 1)
                more = (low - 2 >= first) & (t[at] == t[np.clip(low - 1, 0, t.size - 1)])
                if not more.any():
                    break
                d, best = better(d, best, np.where(more, np.abs(q - t[at]), np.inf), np.where(more, i[at], _NONE))
                low = np.where(more, low - 1, first)
            ok = (best != _NONE) & (d <= tol)
            yield pa.RecordBatch.from_arrays([pa.array(col("id")[ok]), pa.array(best[ok]), pa.array(d[ok])], schema=out)

    return run


def match_nearest(samples: DataFrame, frames: DataFrame, tolerances: DataFrame, keep_unmatched: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(sample_id, index, dt): each sample with the frame of its episode nearest in time, if within its sensor's tolerance.

    Differences are those of doubles; on a tie the smaller index wins; a frame may serve several samples. One shuffle moves both tables, by
    ranges of episode, time and id, so an episode or an instant with any number of rows is many tasks' work. A task walks its
    rows in shards of bounded size, each with a learned index; samples at the edges of a task's range meet the edge frames of the
    others, two a task, in a second step. So the tolerance plays no part in the sharding and may be infinite.

    Null, NaN and infinite times match nothing, nor does a null episode or id, a sensor without a tolerance, or a
    null, NaN or negative tolerance. Repeated rows count once; if a sensor has several tolerances, or a sample several sensors at one time, the largest
    holds. ``keep_unmatched`` also returns samples without a frame, with index and dt null, one row each.
    Empty tables give an empty result. Only the named columns are read, so others may clash.
    """
    ws = Workspace(samples.sparkSession, "nearest")
    tol = tolerances.select("sensor_key", F.col("tolerance_s").cast("double").alias("tol")).filter("tol >= 0 and not isnan(tol) and sensor_key is not null").groupBy("sensor_key").agg(F.max("tol").alias("tol"))
    finite = "e is not null and id is not null and t is not null and not isnan(t) and abs(t) < double('infinity')"
    f = frames.select(F.col("episode_index").cast("long").alias("e"), F.col("timestamp").cast("double").alias("t"), F.lit(0).cast("byte").alias("kind"), F.col("index").cast("long").alias("id"), F.lit(0.0).alias("tol")).filter(finite)
    x = samples.select(F.col("episode_index").cast("long").alias("e"), F.col("timestamp").cast("double").alias("t"), F.lit(1).cast("byte").alias("kind"), F.col("sample_id").cast("long").alias("id"), "sensor_key").filter(finite)
    both = f.unionByName(lookup_join(x, tol, ["sensor_key"]).drop("sensor_key"))
    key = ["e", "t", "kind", "id"]
    walked = both.repartitionByRange(*key).sortWithinPartitions(*key, F.desc("tol")).mapInArrow(_walk(chunk_rows), "what byte, e long, t double, id long, tol double, index long, dt double")
    walked = ws.save(walked, "walked")
    edges = [(r["e"], r["t"], r["id"]) for r in walked.filter(F.col("what") == EDGE).select("e", "t", "id").collect()]  # two a task
    opened = walked.filter(F.col("what") == OPEN).select("e", "t", "id", "tol", "index", "dt").mapInArrow(_resolve(edges), "sample_id long, index long, dt double")
    found = walked.filter(F.col("what") == FOUND).select(F.col("id").alias("sample_id"), "index", "dt").unionByName(opened)
    if not keep_unmatched:
        return found
    every = samples.select(F.col("sample_id").cast("long").alias("sample_id")).distinct()
    return every.join(found, ["sample_id"], "left")  # one row a key on both sides
