"""Splitting oversized texts at natural boundaries, all cuts at once by pointer doubling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrata.llm.mixing import normal_source
from epistrata.llm.tokens import CACHE_WORDS, DEFAULT_VOCABULARY, Tokenizer, tokenizer
from epistrata.runtime import lookup_join

#: Characters of text whose boundaries are joined at once in a task.
BATCH_CHARS = 2_000_000
#: What may end a sentence or clause; a line end always is a natural boundary.
ENDS = frozenset(".!?。！？…；;")
WRAPS = "\"')]}»”’」』）"
SENTENCE, WORD, JOINT, INSIDE = 4, 3, 2, 1
#: A piece starts at a word if one starts within so many tokens before the place the overlap asks for.
REACH = 16


#: Bits of a pre-token's features above its tokens and characters.
_ENDS, _LINE, _ASCII, _BLANK, _LEADS = (1 << k for k in range(56, 61))


class Features(dict):
    """Maps a pre-token to its tokens, characters and what it is at a boundary, packed into one number."""

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok = tok

    def __missing__(self, w: str) -> int:
        last = w[-1]
        v = self.tok[w] | len(w) << 28
        if last in ENDS or "\n" in w or (last in WRAPS and w.rstrip(WRAPS)[-1:] in ENDS):
            v |= _ENDS
        v |= ("\n" in w) * _LINE | last.isascii() * _ASCII | w.isspace() * _BLANK | w[0].isspace() * _LEADS
        if len(w) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[w] = v
        return v


@lru_cache(maxsize=4)
def _features(tok: Tokenizer) -> Features:
    return Features(tok)


def boundaries(tok: Tokenizer, text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions where a text may be cut, in tokens and in characters, their level, and how many tokens more a part has that ends there; the start and the end included.

    Between pre-tokens the counts of the parts add up exactly, but for blanks that are one pre-token at a part's end and two before a word. Only a pre-token too long for a piece (a run of Chinese, a base64 blob) has
    boundaries inside, where a token ends with a character.
    """
    words = tok.words(text)
    f = np.fromiter(map(_features(tok).__getitem__, words), np.int64, len(words))
    counts, lengths = f & ((1 << 28) - 1), f >> 28 & ((1 << 28) - 1)
    leads, blank, after = f & _LEADS != 0, f & _BLANK != 0, np.zeros(len(words), bool)
    after[:-1] = leads[1:]
    # "3.5" and "obs.state" are no sentence ends: white space must follow, or the mark be a full-width one
    inner = (f & _LINE == 0) & (f & _ASCII != 0) & ~after
    inner[-1:] = False
    ends = f & _ENDS != 0
    level = np.where(ends & ~inner, SENTENCE, np.where(after & ~ends, WORD, JOINT)).astype(np.int8)
    more = np.zeros(len(words), np.int64)
    for i in np.flatnonzero(blank[1:] & blank[:-1]) + 1:
        j = i - 1
        while j and blank[j - 1]:
            j -= 1
        more[i] = tok["".join(words[j : i + 1])] - counts[j : i + 1].sum()
    pos, chars = np.cumsum(counts), np.cumsum(lengths)
    long = np.flatnonzero(counts > max(1, min(16, (limit - overlap) // 2)))
    if long.size:
        parts = []
        done = 0
        for i in long:
            parts.append(np.stack([pos[done:i], chars[done:i], level[done:i], more[done:i]]))
            inner = [(n, k) for n, k in tok.cuts(words[i]) if n < counts[i]]
            if inner:
                a = np.array(inner).T
                parts.append(np.stack([a[0] + pos[i] - counts[i], a[1] + chars[i] - lengths[i], np.full(a.shape[1], INSIDE), np.zeros(a.shape[1], np.int64)]))
            done = i
        parts.append(np.stack([pos[done:], chars[done:], level[done:], more[done:]]))
        pos, chars, level, more = np.concatenate(parts, axis=1)
    zero = np.zeros(1, np.int64)
    return np.concatenate([zero, pos]), np.concatenate([zero, chars]), np.concatenate([[SENTENCE], level]).astype(np.int8), np.concatenate([zero, more])


def _starts(pos: np.ndarray, level: np.ndarray, at: np.ndarray, first: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Where the piece after a cut starts: the last word start at least ``overlap`` tokens before it, if it isn't far, else the last boundary."""
    near = np.maximum(np.searchsorted(pos, pos[at] - overlap, "right") - 1, first)
    word = np.maximum(np.maximum.accumulate(np.where(level >= WORD, np.arange(pos.size), 0))[near], first)
    return np.where(pos[at] - overlap - pos[word] <= REACH, word, near)


def cut_all(pos: np.ndarray, level: np.ndarray, first: np.ndarray, last: np.ndarray, limit: np.ndarray, overlap: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces of all texts; ``more`` is added to the overlap asked for at each boundary.

    ``pos`` are the boundaries' positions, those of a text between ``first`` and ``last``, texts further apart than any limit. Every
    boundary is joined to its successor: where the piece after a cut there would end, which is the farthest
    sentence or line end within the limit, else the farthest word end (either if it leaves the piece at least half full), else any boundary. Squaring the successor table
    and marking what the marked ones reach gives all greedy cuts in as many rounds as the bits of their number.
    """
    n = pos.size
    at = np.arange(n)
    text = np.repeat(np.arange(first.size), last - first + 1)
    f, z, lim, ov = first[text], last[text], limit[text], np.minimum(overlap, np.maximum(limit - 1, 0))[text]
    ov = np.where(ov > 0, np.maximum(ov + more, 0), 0)
    start = np.where(at == f, f, _starts(pos, level, at, f, ov))

    def farthest(s: np.ndarray) -> np.ndarray:
        any_ = np.minimum(np.searchsorted(pos, pos[s] + lim, "right") - 1, z)
        word = np.maximum.accumulate(np.where(level >= WORD, at, 0))[any_]
        sentence = np.maximum.accumulate(np.where(level >= SENTENCE, at, 0))[any_]
        least = np.maximum(pos[s] + lim // 2, pos + 1)  # a natural boundary must leave a piece half full
        return np.where(any_ == z, z, np.where(pos[sentence] >= least, sentence, np.where(pos[word] >= least, word, any_)))

    succ = farthest(start)
    stuck = succ <= at  # the overlap leaves no room for the next boundary: start after the cut
    start = np.where(stuck, at, start)
    succ = np.where(stuck, farthest(start), succ)
    succ = np.where(succ <= at, np.minimum(at + 1, z), succ)  # one character is above the limit
    succ[last] = last
    table, marked = succ.copy(), np.zeros(n, bool)
    marked[first] = True
    while True:
        marked[table[np.flatnonzero(marked)]] = True
        if (table[first] == last).all():
            break
        table = table[table]
    ends = np.flatnonzero(marked & (at != f))
    before = np.flatnonzero(marked)
    prev = before[np.searchsorted(before, ends, "left") - 1]
    return start[prev], ends


def split_texts(tok: Tokenizer, texts: list[str], limits: list[int], overlaps: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each text above its limit the pieces (first character, end, tokens); for others an empty list."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    made: dict[int, tuple[np.ndarray, ...]] = {}
    todo: dict[int, int] = {}
    for i, t in enumerate(texts):
        if len(t.encode("utf-8", "surrogatepass")) > limits[i]:
            p, ch, lv, more = boundaries(tok, t, limits[i], overlaps[i])
            if p[-1] > limits[i]:
                made[i] = (p, ch, lv, more, -more)  # a part with fewer tokens at its end needs as many more before
                todo[i] = limits[i]
    rounds = 0
    while todo:
        rounds += 1
        who, gap = list(todo), max(todo.values()) + max(max(0, overlaps[i]) for i in todo) + 2
        arrays, base = [], 0
        for i in who:
            p, *rest = made[i]
            arrays.append((p + base, *rest))
            base += int(p[-1]) + gap + int(made[i][4].max(initial=0))
        pos, chars, level, more, need = (np.concatenate(x) for x in zip(*arrays))
        last = np.cumsum([a[0].size for a in arrays]) - 1
        first = np.concatenate([[0], last[:-1] + 1])
        s, e = cut_all(pos, level, first, last, np.array([todo[i] for i in who]), np.array([max(0, overlaps[i]) for i in who]), need)
        owner = np.searchsorted(last, e, "left")
        inside = level == INSIDE
        n = pos[e] - pos[s] + more[e]
        again: dict[int, int] = {}
        prev = -1
        for a, b, k, m in zip(s.tolist(), e.tolist(), owner.tolist(), n.tolist()):
            i = who[k]
            if prev != k:
                out[i], before = [], None
            if inside[a] or inside[b] or (more[b] and texts[i][chars[a] : chars[b]].isspace()):  # cut inside a pre-token: its part may tokenize otherwise
                m = tok.count(texts[i][chars[a] : chars[b]])
            out[i].append((int(chars[a]), int(chars[b]), m))
            if m > limits[i] and chars[b] - chars[a] > 1 and todo[i] > 1:  # rare: cut this text again with a little less room
                again[i] = min(again.get(i, todo[i]), todo[i] - max(1, m - limits[i]))
            want = min(overlaps[i], limits[i] - 1)
            if before is not None and want > 0 and first[k] < a < before and (inside[a] or inside[before] or (more[before] and texts[i][chars[a] : chars[before]].isspace())):
                short = want - tok.count(texts[i][chars[a] : chars[before]])
                if short > 0:  # rare too: ask for more before this cut; after some rounds before all cuts inside pre-tokens
                    made[i][4][before - first[k]] += short
                    if rounds >= 8:
                        made[i][4][made[i][2] == INSIDE] += 1
                    again.setdefault(i, todo[i])
            prev, before = k, b
        todo = again
    return out


def _splitter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            ids, sources, limits, overlaps, texts = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(ids):
                end, chars = at, 0
                while end < len(ids) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                rows = []
                for i, pieces in enumerate(split_texts(tok, texts[at:end], limits[at:end], overlaps[at:end]), start=at):
                    rows += [(ids[i], sources[i], k, a, z, n, texts[i][a:z]) for k, (a, z, n) in enumerate(pieces)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                at = end

    return run


def split_oversized(documents: DataFrame, limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, piece_no, start_char, end_char, n_tokens, text): the pieces of every text above its source's limit.

    No piece has more than ``max_tokens``. Pieces end at the farthest sentence or line end within the limit, else at a word's end, if that
    leaves them at least half full, else between characters. Each starts at the last word start for which what it shares with the previous one,
    tokenized by itself, has at least ``overlap_tokens`` tokens, so by less than a word too much; where no word starts within 16 tokens of that
    place, at the last place at least so far back where a token starts with a character. Joined without their overlaps the pieces are the text. A text within its limit gives no row.

    Null texts, and sources that are null or have no limit, are not cut. Sources match without case and outer blanks. An
    overlap of null or below 0 counts as 0, one not below the limit as the limit less one; where it leaves no
    room for the next boundary, the piece starts at the cut. A limit null or below 1 is none; of several rows for a source the smallest limit and
    largest overlap hold. A character (with a blank that its first token holds) of more tokens than the limit is a piece by itself. An overlap
    above half the limit may start a piece before the one before it. Repeated rows are cut each.
    """
    lim = limits.select(normal_source(F.col("source")).alias("src"), F.col("max_tokens").cast("int").alias("max_tokens"), F.greatest(F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)), F.lit(0)).alias("ov")).filter("max_tokens >= 1 and src is not null")
    lim = lim.groupBy("src").agg(F.min("max_tokens").alias("lim"), F.max("ov").alias("ov"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normal_source(F.col("source")).alias("src"), "text").filter(F.col("text").isNotNull() & F.col("src").isNotNull())
    near = lookup_join(docs, lim, ["src"]).filter(F.octet_length("text") > F.col("lim"))  # a token has a byte at least
    return near.select("doc_id", "src", "lim", "ov", "text").mapInArrow(_splitter(vocabulary), "doc_id long, source string, piece_no int, start_char long, end_char long, n_tokens long, text string")
