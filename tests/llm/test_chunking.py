import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epistrata.llm import chunking
from epistrata.llm.tokens import DEFAULT_VOCABULARY, tokenizer

TOK = tokenizer(DEFAULT_VOCABULARY)
count = lambda t: len(TOK.encoding.encode_ordinary(t))
D, L = "doc_id long, text string, source string, src string, lim int", "source string, max_tokens int, overlap_tokens int"


def check(text, limit, overlap):
    pieces = chunking.split_texts(TOK, [text], [limit], [overlap])[0]
    if count(text) <= limit:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, z, n in pieces:
        assert n == count(text[a:z]) and (n <= limit or len(TOK.cuts(text[a:z])) == 1) and a < z
    want = min(overlap, limit - 1)
    for (a, z, _), (b, y, _) in zip(pieces, pieces[1:]):
        assert b <= z < y and (a < b or 2 * overlap + 2 * chunking.REACH > limit)
        if 0 < b < z and want > 0:  # never short, and too long by less than a word, or a pre-token where words are long
            n = count(text[b:z])
            word = text[b:z].split(None, 1)
            assert n >= want and (n == want or n - count(text[b : b + len(text[b:z]) - len(word[1])] if len(word) > 1 else text[b:z]) <= want + 1), (text[b:z], n, want)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "A sentence ends. ", "\n\n", "line\n", "上海夹爪打滑两次。", "高精度", "x" * 40, "  ", "obs.state ", "3.5", "🙂", "\t", "it's ", "! ", "é́"]), max_size=60), st.integers(1, 40), st.integers(0, 20))
def test_pieces_keep_the_limit_and_all_text(parts, limit, overlap):
    check("".join(parts), limit, overlap)


def test_cuts_are_natural_and_overlap(spark):
    text = " ".join(f"This is sentence number {k} of the log." for k in range(100))
    pieces = check(text, 100, 20)
    assert all(text[z - 1] == "." for _, z, _ in pieces)
    for (_, z, _), (b, _, _) in zip(pieces, pieces[1:]):
        assert 20 <= count(text[b:z]) < 30 and (text[b] == " ")


def test_greedy_equals_a_walk():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 200))
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 6, n))])
        level = np.concatenate([[4], rng.choice([2, 3, 4], n)])
        lim, ov = int(rng.integers(8, 40)), int(rng.integers(0, 7))
        s, e = chunking.cut_all(pos, level, np.array([0]), np.array([n]), np.array([lim]), np.array([ov]))
        start, at, walk = 0, 0, []
        while at < n:
            room = [j for j in range(at + 1, n + 1) if pos[j] <= pos[start] + lim]
            good = [j for j in room if pos[j] >= pos[start] + lim // 2]
            end = n if n in room else max([j for j in good if level[j] >= 4] or [j for j in good if level[j] >= 3] or room)
            walk.append((start, end))
            at = end
            near = max(j for j in range(n + 1) if pos[j] <= max(0, pos[end] - ov))
            word = max(j for j in range(near + 1) if level[j] >= 3)
            start = word if pos[end] - ov - pos[word] <= chunking.REACH else near
            if not [j for j in range(at + 1, n + 1) if pos[j] <= pos[start] + lim]:
                start = end
        assert list(zip(s.tolist(), e.tolist())) == walk


def test_many_texts_at_once_equal_one_by_one():
    texts = ["word " * k + "end. " * (k % 7) for k in range(0, 300, 13)] + ["", "上海" * 200]
    lims, ovs = [20 + k for k in range(len(texts))], [k % 9 for k in range(len(texts))]
    assert chunking.split_texts(TOK, texts, lims, ovs) == [chunking.split_texts(TOK, [t], [a], [b])[0] for t, a, b in zip(texts, lims, ovs)]


@pytest.mark.parametrize("text", ["x" * 3000, "夹" * 3000, "🙂" * 500, " " * 4000, "\n" * 3000, "a." * 1000])
def test_texts_without_natural_boundaries(text):
    check(text, 50, 10)


def test_operator(spark):
    long = "One two three. " * 40
    docs = [(1, long, "LOG "), (1, long, "LOG "), (2, "short", "log"), (3, None, "log"), (4, "", "log"), (5, long, None), (6, long, "other"), (None, long, "log"), (7, long, "bad")]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], D)
    lim = spark.createDataFrame([("log", 50, 5), ("log", 60, 3), ("bad", 0, 1), ("bad", None, 1), (None, 5, 1), ("over", 3, 99)], L)
    out = chunking.split_oversized(d, lim).toPandas()
    assert set(out.doc_id.dropna()) == {1} and out.doc_id.isna().any() and out.n_tokens.max() <= 50
    assert (out[out.doc_id == 1].groupby("piece_no").size() == 2).all()
    assert chunking.split_oversized(d.limit(0), lim).count() == 0 and chunking.split_oversized(d, lim.limit(0)).count() == 0
    assert check("a b c d e f g", 3, 99)
