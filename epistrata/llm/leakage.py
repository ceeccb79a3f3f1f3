"""Evaluation texts leaking into training text, found by greedy string tiling."""

from __future__ import annotations

import heapq
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrata.runtime import Workspace, hot_join

#: Words an unbroken passage must share with an item to count as leaked.
MIN_RUN = 13
#: Tiles and coverage by which reordered passages are caught.
TILE, COVERAGE = 5, 0.8
#: Characters of text searched at once in a task.
BATCH_CHARS = 2_000_000
#: The filter that keeps words' windows out of the shuffle: so many bits for each window of an item, at most so many in all (16 MB).
FILTER_BITS, MOST_BITS = 32, 1 << 27
#: Words whose hashes a task remembers.
CACHE_WORDS = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_M64 = (1 << 64) - 1


def _class_of(*categories: str) -> str:
    """Regular-expression class of all characters of these categories."""
    out, start, prev = [], None, None
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i)) in categories:
            if start is None:
                start = i
            prev = i
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{prev:08x}")
            start = None
    return "[" + "".join(out) + "]+"


_drop: list[re.Pattern] = []
_ascii_words = re.compile(r"[a-z0-9]+").findall
_any_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, without letter case, accents, width forms and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return _ascii_words(text.lower())
    if not _drop:
        _drop.append(re.compile(_class_of("Mn", "Cf")))
    flat = _drop[0].sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _any_words(flat if unicodedata.is_normalized("NFKD", flat) else _drop[0].sub("", unicodedata.normalize("NFKD", flat)))


class WordCodes(dict):
    """Maps a word to its 64-bit hash."""

    def __missing__(self, w: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return v


def _mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Karp-Rabin fingerprints of all windows of a sequence of codes, rolled once for every width.

    With C the base, S(i) sums codes k < i times C^k; the window of width w at i is (S(i + w) - S(i)) / C^i, all modulo 2^64, where
    an odd base has an inverse. So any width costs one subtraction and one product a window. Two bases give 128 bits.
    """

    def __init__(self, codes: np.ndarray):
        self.sums, self.scale = [], []
        for k, base in enumerate(BASES):
            n = codes.size
            power = self._powers(base, n)
            m = _mix(codes + np.uint64(k))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * power, dtype=np.uint64)]))
            self.scale.append(self._powers(pow(base, -1, 1 << 64), n))

    _known: dict[int, np.ndarray] = {}

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        have = cls._known.get(base)
        if have is None or have.size < n:
            have = np.full(max(1024, n + min(n, 1 << 20)), base & _M64, np.uint64)
            have[0] = 1
            have = cls._known[base] = np.multiply.accumulate(have)
        return have[:n]

    def at(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the windows at these places."""
        return tuple(_mix((s[places + width] - s[places]) * inv[places] + np.uint64(width)).view(np.int64) for s, inv in zip(self.sums, self.scale))


SEEDS = "h long, g long, item_id long, item_key long, pos int, size int, width int"
HITS = "h long, g long, doc_id long, doc_key long, at long"


def _seeds_of(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All windows of ``tile`` words of the items, the whole item where it has fewer."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3
    names = [x.split()[0] for x in SEEDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            for ident, key, text in zip(*(col.to_pylist() for col in b.columns)):
                ws = words(text)
                if not ws:
                    continue
                width = min(tile, len(ws))
                pos = np.arange(len(ws) - width + 1)
                h, g = Rolling(np.fromiter(map(codes.__getitem__, ws), np.uint64, len(ws))).at(pos, width)
                same = lambda v, n=pos.size: np.full(n, v)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((h, g, same(ident), same(key), pos, same(len(ws)), same(width)), kinds)], names=names)

    return run


def _bit(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    u = h.view(np.uint64)
    return u & mask, (u >> np.uint64(32)) & mask


def seed_filter(seeds: DataFrame, windows: int) -> np.ndarray:
    """Bits set for two parts of every seed's fingerprint. Its size is bounded; more seeds only let more other windows pass, never fewer of their own."""
    bits = 1 << 16
    while bits < min(MOST_BITS, FILTER_BITS * windows):
        bits *= 2
    places = seeds.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("b"))
    packed = places.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int"))).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[packed.column("word").to_numpy()] = packed.column("mask").to_numpy()
    return out.view(np.uint64)


def _scan(widths: list[int], tile: int, table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of the documents that pass the filter."""
    names = [x.split()[0] for x in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table_ = WordCodes(), table.value
        bits = table_.size * 64

        def search(ids: pa.Array, keys: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
            parts = [words(t) for t in texts]
            sizes = np.array([len(p) for p in parts])
            every = np.fromiter((codes[w] for p in parts for w in p), np.uint64, int(sizes.sum()))
            rolled = Rolling(every)
            ends = np.cumsum(sizes)
            left = np.repeat(ends, sizes) - np.arange(every.size)  # words from each place to its text's end
            doc = np.repeat(np.arange(sizes.size), sizes)
            for width in widths:
                at = np.flatnonzero(left >= width)
                if not at.size:
                    continue
                h, g = rolled.at(at, width)
                a, z = _bit(h, bits)
                ok = ((table_[a >> np.uint64(6)] >> (a & np.uint64(63))) & (table_[z >> np.uint64(6)] >> (z & np.uint64(63))) & np.uint64(1)).astype(bool)
                at, h, g = at[ok], h[ok], g[ok]
                if width < tile and at.size:  # a whole item: one place of a text is as good as all
                    _, first = np.unique(np.stack([doc[at], h]), axis=1, return_index=True)
                    at, h, g = at[first], h[first], g[first]
                if at.size:
                    d = doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), ids.take(pa.array(d)), pa.array(keys[d]), pa.array(at - (ends - sizes)[d])], names=names)

        for b in batches:
            texts = b.column(2).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                yield from search(b.column(0).slice(start, end - start), b.column(1).slice(start, end - start).to_numpy(), texts[start:end])
                start = end

    return run


def tiles(at: np.ndarray, pos: np.ndarray, width: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item of ``size`` words with a document from their shared windows: (place, item place, length), longest first.

    Windows next to each other on a diagonal join to maximal matches; the longest is marked, what others share with it
    is cut off, and so on while a match of ``width`` unmarked words is left.
    """
    order = np.lexsort((at, at - pos))
    at, pos = at[order], pos[order]
    fresh = np.ones(at.size, bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.concatenate([first, [at.size]])) + width - 1
    low = int(at.min())
    in_doc, in_item, left = np.zeros(int(at.max()) - low + width, bool), np.zeros(size, bool), size
    queue = [(-int(n), int(at[i]), int(pos[i])) for i, n in zip(first, length)]
    heapq.heapify(queue)
    out: list[tuple[int, int, int]] = []
    while queue and left >= width:
        n, a, p = heapq.heappop(queue)
        n = -n
        taken = in_doc[a - low : a - low + n] | in_item[p : p + n]
        if taken.any():  # what is left of it on both sides of marked words
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for b, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if e - b >= width:
                    heapq.heappush(queue, (b - e, a + b, p + b))
        else:
            in_doc[a - low : a - low + n] = True
            in_item[p : p + n] = True
            left -= n
            out.append((a, p, n))
    return out


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest_run", pa.int32()), ("n_tiles", pa.int32()), ("covered_words", pa.int32()), ("item_words", pa.int32())])


def tile_pairs(tab: pa.Table, min_run: int, coverage: float | None) -> pa.RecordBatch | None:
    """Rows of the pairs that hold enough of an item; the table has whole pairs, sorted by pair, then item place and place."""
    doc, dk, item, ik, pos, at, size, width = (tab.column(k).combine_chunks() for k in ("doc_id", "doc_key", "item_id", "item_key", "pos", "at", "size", "width"))
    dk, item, ik, pos, at, size, width = (x.to_numpy() for x in (dk, item, ik, pos, at, size, width))
    null = doc.is_null().to_numpy(zero_copy_only=False)
    dn = doc.fill_null(0).to_numpy()
    new = np.ones(dk.size, bool)
    new[1:] = (dk[1:] != dk[:-1]) | (ik[1:] != ik[:-1]) | (item[1:] != item[:-1]) | (dn[1:] != dn[:-1]) | (null[1:] != null[:-1])
    cuts = np.flatnonzero(new)
    ends = np.concatenate([cuts[1:], [dk.size]])
    # words of the item that some shared window covers: a bound on what tiles can cover
    step = np.concatenate([[0], np.diff(pos)])
    gain = np.where(new, width, np.minimum(width, step))
    bound = np.add.reduceat(gain, cuts)
    n = size[cuts]
    least = np.minimum(min_run, n) if coverage is None else np.minimum(np.minimum(min_run, n), np.ceil(coverage * n - 1e-9))
    rows = []
    for a, z in zip(cuts[bound >= least].tolist(), ends[bound >= least].tolist()):
        found = tiles(at[a:z], pos[a:z], int(width[a]), int(size[a]))
        longest, covered, whole = found[0][2], sum(m[2] for m in found), int(size[a])
        if longest >= min(min_run, whole) or (coverage is not None and covered >= coverage * whole - 1e-9):
            rows.append((None if null[a] else int(dn[a]), int(item[a]), longest, len(found), covered, whole))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), OUT)], schema=OUT) if rows else None


def _tile(min_run: int, coverage: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        key = ("doc_id", "doc_key", "item_id", "item_key")
        last: tuple | None = None

        def go() -> Iterator[pa.RecordBatch]:
            tab = pa.Table.from_batches(kept)
            at, pos = tab.column("at").to_numpy(), tab.column("pos").to_numpy()
            dk, ik = tab.column("doc_key").to_numpy(), tab.column("item_key").to_numpy()
            again = np.zeros(at.size, bool)  # rows of a document that was sent again
            again[1:] = (at[1:] == at[:-1]) & (pos[1:] == pos[:-1]) & (dk[1:] == dk[:-1]) & (ik[1:] == ik[:-1])
            ids = [tab.column(k).combine_chunks().fill_null(-1).to_numpy() for k in ("doc_id", "item_id")]
            for x in ids:
                again[1:] &= x[1:] == x[:-1]
            out = tile_pairs(tab.filter(pa.array(~again)) if again.any() else tab, min_run, coverage)
            if out is not None:
                yield out

        for b in batches:
            if not b.num_rows:
                continue
            head, tail = (tuple(b.column(k)[n].as_py() for k in key) for n in (0, b.num_rows - 1))
            if kept and head != last:
                yield from go()
                kept = []
            last = tail
            if head == tail:
                kept.append(b)
                continue
            dk, ik = b.column("doc_key").to_numpy(), b.column("item_key").to_numpy()
            ids = [b.column(k).fill_null(-1).to_numpy() for k in ("doc_id", "item_id")]
            other = (dk != dk[-1]) | (ik != ik[-1]) | (ids[0] != ids[0][-1]) | (ids[1] != ids[1][-1])
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                kept.append(b.slice(0, cut))
                yield from go()
                kept = [b.slice(cut)]
            else:
                kept.append(b)
        if kept:
            yield from go()

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, tile: int = TILE, min_run: int = MIN_RUN, coverage: float | None = COVERAGE) -> DataFrame:
    """(doc_id, item_id, longest_run, n_tiles, covered_words, item_words, coverage): every document that holds passages of an item.

    Seeds are the items' windows of ``tile`` words (all of a shorter item), written as a table of Karp-Rabin fingerprints of 128 bits. Documents are
    read once; a bounded bit filter of the seeds keeps windows that no item has out of the shuffle, and the rest is joined with the seeds,
    hot seeds split. Pairs of document and item are then tiled from their shared windows. A pair comes out if one tile has at least ``min_run``
    words or the whole item, or if its tiles, in any order, cover at least ``coverage`` of the item; with coverage None and tile = min_run only the former.

    Neither texts nor seeds of items come to the driver, only the filter (at most MOST_BITS bits). A task holds the shared windows of one pair at a
    time. Whole texts are searched.

    Null and empty texts, and items without words, hold and are held by nothing. Repeated rows count once. A null doc_id is
    reported as null; items with a null id are left out. Empty tables give an empty result. Extra columns are not read.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "leakage")
    ready = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text").filter("item_id is not null and text is not null and text != ''").distinct()
    seeds = ws.save(ready.mapInArrow(_seeds_of(tile), SEEDS), "seeds")
    told = seeds.groupBy("width").count().collect()  # at most ``tile`` rows
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text").filter("text is not null and text != ''")
    table = spark.sparkContext.broadcast(seed_filter(seeds, sum(r["count"] for r in told)))
    hits = ws.save(docs.mapInArrow(_scan(sorted(r["width"] for r in told), tile, table), HITS), "hits")
    pairs = hot_join(hits, seeds, ["h", "g"], left_rows=hits.count()).select("doc_id", "doc_key", "item_id", "item_key", "pos", "at", "size", "width")
    found = pairs.repartition("doc_key", "item_key").sortWithinPartitions("doc_key", "doc_id", "item_key", "item_id", "pos", "at").mapInArrow(_tile(min_run, coverage), "doc_id long, item_id long, longest_run int, n_tiles int, covered_words int, item_words int")
    # an item given with several texts, or a document in several rows, counts by its best match
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("longest_run", "covered_words", "n_tiles", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.longest_run", "b.n_tiles", "b.covered_words", "b.item_words", (F.col("b.covered_words") / F.col("b.item_words")).alias("coverage"))


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents, longest_run, max_coverage) of every item; 0 documents where it did not leak."""
    per = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest_run").alias("longest_run"), F.max("coverage").alias("max_coverage"))
    every = items.select(F.col("item_id").cast("long").alias("item_id")).filter("item_id is not null").distinct()
    return every.join(per, ["item_id"], "left").na.fill(0, ["documents", "longest_run"]).na.fill(0.0, ["max_coverage"])
