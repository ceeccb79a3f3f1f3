import random
import unicodedata

import pytest
import regex

from epistrata import runtime
from epistrata.llm import leakage as lk

D, I = "doc_id long, text string, item_id string, b string", "item_id long, text string, doc_id string, b string"


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "c", "c") for x in docs], D)
    i = spark.createDataFrame([(*x, "c", "c") for x in items], I)
    return {(r.doc_id, r.item_id): r for r in lk.leaked_passages(d, i, **more).collect()}


def plain_words(t):
    t = "".join(ch for ch in unicodedata.normalize("NFKD", t or "") if unicodedata.category(ch) not in ("Mn", "Cf")).casefold()
    return regex.findall(r"[\p{L}\p{N}]+", t)


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            v = plain_words(x)
            n = min(13, len(v))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if n and i is not None and any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_words():
    assert lk.words("Ｆｕｌｌ-width, Café, soft­hyphen zero​width ﻿STRASSE straße snake_case 3.5") == ["full", "width", "cafe", "softhyphen", "zerowidth", "strasse", "strasse", "snake", "case", "3", "5"]
    assert lk.words(None) == lk.words("") == lk.words("... !") == [] and lk.words("上海 夹爪") == ["上海", "夹爪"]


@pytest.mark.parametrize("seed", [1, 2])
def test_found_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["Ünder", "straße", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 5, 12, 13, 14, 40]))) for k in range(60)] + [(100, ""), (101, None), (102, "!!"), (None, say(20)), (5, say(20))]
    docs = []
    for k in range(150):
        t = say(rng.randrange(0, 60))
        if rng.random() < 0.5:
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(v) - 11))
            t += " " + ", ".join(v[a : a + rng.choice([12, 13, 20])]).upper() + " " + say(5)
        docs.append((k, t))
    docs += docs[:5] + [(None, items[0][1]), (500, None), (501, ""), (502, say(20_000) + " " + items[5][1])]
    assert set(leaks(spark, docs, items, tile=13, coverage=None)) == brute(docs, items)


@pytest.mark.parametrize("most", [1 << 16, 1 << 27])
def test_a_full_filter_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(lk, "MOST_BITS", most)
    monkeypatch.setattr(lk, "FILTER_BITS", 1)
    items = [(k, " ".join(f"a{k}x{j}" for j in range(20))) for k in range(30)]
    docs = [(k, items[k][1]) for k in range(30)]
    assert set(leaks(spark, docs, items)) == {(k, k) for k in range(30)}


def test_a_hot_passage_is_split(spark, monkeypatch):
    """A passage that all items share and most documents repeat."""
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    shared = " ".join(f"s{k}" for k in range(15))
    items = [(k, f"{shared} own{k}") for k in range(9)]
    docs = [(k, f"{shared} x " * (k % 4)) for k in range(12)]
    got = leaks(spark, docs, items, tile=13, coverage=None)
    assert sorted(got) == sorted((d, i) for d, t in docs if t for i, _ in items)
    assert all((r.longest_run, r.n_tiles, r.covered_words, r.item_words) == (15, 1, 15, 16) for r in got.values())


def test_rolling_equals_each_window_by_itself():
    import numpy as np

    codes = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    for width in (1, 5, 13):
        at = np.arange(codes.size - width + 1)
        h, g = lk.Rolling(codes).at(at, width)
        for k in (0, 7, at[-1]):
            a, b = lk.Rolling(codes[k : k + width]).at(np.zeros(1, np.int64), width)
            assert a[0] == h[k] and b[0] == g[k]
        assert len(set(h.tolist())) == at.size


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recall_of_reordered_passages(spark, seed):
    """Items cut into passages of 5 words or more, shuffled, with fillers between and some words lost: all that keep the coverage come out."""
    rng = random.Random(seed)
    say = lambda n, k: [f"{k}w{rng.randrange(10**6)}" for _ in range(n)]
    items = {k: say(rng.randrange(20, 60), k) for k in range(40)}
    docs, true = [], set()
    for d in range(120):
        k = rng.randrange(40)
        w, parts, at = items[k], [], 0
        while at < len(w):
            n = min(rng.randrange(5, 10), len(w) - at)
            parts.append(w[at : at + n])
            at += n
        parts = [p for p in parts if rng.random() < 0.95]
        rng.shuffle(parts)
        if sum(len(p) for p in parts if len(p) >= 5) >= 0.8 * len(w):
            true.add((d, k))
        docs.append((d, " ".join(" ".join(p + say(2, "f")) for p in parts)))
    got = set(leaks(spark, docs, [(k, " ".join(w)) for k, w in items.items()]))
    assert len(true) > 50 and true <= got
    other = got - true  # neighbours that fell together again, or a part short of five words that follows its predecessor
    assert len(other) <= 0.2 * len(got)


def test_reordered_passages_are_caught(spark):
    w = [f"q{k}" for k in range(40)]
    shuffled = w[30:40] + ["x"] + w[20:30] + ["y"] + w[0:10] + ["z"] + w[10:20]
    got = leaks(spark, [(1, " ".join(shuffled)), (2, " ".join(w[:10])), (3, " ".join(w[::-1]))], [(7, " ".join(w))])
    assert set(got) == {(1, 7)}
    r = got[1, 7]
    assert (r.longest_run, r.n_tiles, r.covered_words, r.item_words, r.coverage) == (10, 4, 40, 40, 1.0)


def test_tiles_do_not_overlap():
    import numpy as np

    # document 1 2 3 4 5 6 1 2 3 9, item 1 2 3 4 5 6, windows of three
    assert lk.tiles(np.array([0, 1, 2, 3, 6]), np.array([0, 1, 2, 3, 0]), 3, 6) == [(0, 0, 6)]


def test_a_text_of_one_word_over_and_over(spark):
    got = leaks(spark, [(1, "go " * 2000), (2, "go"), (1, "go " * 2000)], [(1, "go " * 40), (1, "go " * 40)])
    assert set(got) == {(1, 1)} and tuple(got[1, 1])[2:6] == (40, 1, 40, 40)


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, "a b c")]) == {} and leaks(spark, [(1, "a b c")], []) == {}


def test_items_report(spark):
    d, i = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c"), (2, "x y")], "item_id long, text string")
    got = {r.item_id: (r.documents, r.longest_run) for r in lk.leaked_items(lk.leaked_passages(d, i), i).collect()}
    assert got == {1: (1, 3), 2: (0, 0)}
