import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrata.llm import mixing
from epistrata.llm.tokens import DEFAULT_VOCABULARY, tokenizer

D, T = "doc_id long, text string, source string, src string, u double, n_tokens int", "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **more):
    return mixing.mix_sources(spark.createDataFrame([(*x, "c", 0.5, 1) for x in docs], D), spark.createDataFrame(targets, T), **more)


def shares(m):
    return {r.source: r for r in m.shares().collect()}


def test_counts_equal_the_tokenizer():
    tok = tokenizer(DEFAULT_VOCABULARY)
    for t in ["", " ", "Hello  world,\n\n it's 3.14\t\r\n  x", "高精度 夹爪　打滑。", "a b\u0085c\x1cd e", "'s't're " * 5, "x" * 5000, "🙂👩‍🚀 naïve", "  \n \n  end  "]:
        assert tok.count(t) == len(tok.encoding.encode_ordinary(t)), t


def test_shares_caps_and_shuffle(spark):
    docs = [(k, "word " * (1 + k % 9), "Big ") for k in range(2000)] + [(5000 + k, "thing " * 5, "small") for k in range(200)] + [(9000 + k, "x", "unlisted") for k in range(9)] + [(9100, "x", None)]
    m = mix(spark, docs, [("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 4)])
    s = shares(m)
    assert abs(s["small"].actual_share - 0.4) < 0.01 and abs(s["big"].actual_share - 0.6) < 0.01
    assert s["absent"].copies == 0 and s["big"].most_repeats <= 1 and s["small"].most_repeats <= 3
    c = m.copies.toPandas()
    assert len(c) == s["big"].copies + s["small"].copies and set(c.source) == {"big", "small"}
    assert c.groupby("doc_id").copy_no.agg(["min", "max", "count"]).apply(lambda r: r["min"] == 1 and r["max"] == r["count"], axis=1).all()
    assert not c.duplicated(["doc_id", "copy_no"]).any() and c.shuffle_key.nunique() == len(c)
    assert sorted(map(str, m.copies.collect())) == sorted(map(str, mix(spark, docs, [("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 4)]).copies.collect()))


def test_a_total_beyond_the_caps_is_reported(spark):
    docs = [(k, "a b c", "a") for k in range(50)] + [(100 + k, "a b c", "b") for k in range(50)]
    s = shares(mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=100_000))
    assert s["a"].copies == 50 and s["b"].copies == 100 and abs(s["a"].actual_share - 1 / 3) < 1e-9


def test_odd_rows(spark):
    docs = [(1, None, "a"), (1, None, "a"), (None, "x y", "a"), (2, "", "a"), (3, "x y z", "b"), (4, "q", "c"), (5, "q", "d")]
    m = mix(spark, docs, [("a", 1.0, 2), (" A", 0.5, 2), ("b", None, 3), ("c", float("nan"), 3), ("d", 0.3, 0), ("d", -1.0, None), (None, 0.5, 1)])
    assert m.copies.groupBy().agg(F.count(F.when(F.col("source") != "a", 1))).first()[0] == 0
    assert m.copies.count() > 0 and shares(m)["a"].documents == 4 and set(shares(m)) == {"a", "b", "c", "d"}
    for d, t in (([], [("a", 1.0, 1)]), (docs, [])):
        assert mix(spark, d, t).copies.count() == 0


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_poisson_steps(cap):
    want = np.cumsum([math.exp(-1.7) * 1.7**k / math.factorial(k) for k in range(cap)])
    base, steps = mixing.poisson_steps(1.7, cap)
    assert base == 0 and np.allclose(steps, want) and mixing.poisson_steps(float("inf"), cap)[0] == cap


@pytest.mark.parametrize("rate", [900.0, 1500.0, 2.5e6])
def test_large_rates(rate):
    """Mean and spread of the draws, with a cap no array could have the length of."""
    base, steps = mixing.poisson_steps(rate, 10**9)
    u = (np.arange(20_000) + 0.5) / 20_000
    n = base + np.searchsorted(steps, u, "right")
    assert steps.size < 25 * math.sqrt(rate) + 200 and abs(n.mean() - rate) < 0.01 * math.sqrt(rate) and abs(n.std() / math.sqrt(rate) - 1) < 0.01
    assert mixing.poisson_steps(rate, 10)[0] == 10 or mixing.poisson_steps(rate, 10)[1].max() < 1e-20


def test_rates_beyond_a_thousand(spark):
    docs = [(k, "a b c d", "rare") for k in range(8)] + [(100 + k, "x y z " * 100, "big") for k in range(40)]
    s = shares(mix(spark, docs, [("rare", 0.5, 2000), ("big", 0.5, 1)], total_tokens=96_000))
    assert s["rare"].rate > 1400 and 1400 * 8 < s["rare"].copies < 1600 * 8 and abs(s["rare"].tokens_used - 48_000) < 0.03 * 48_000


def test_effective_targets(spark):
    s = shares(mix(spark, [(k, "a b", "a") for k in range(9)] + [(20 + k, "a b", "b") for k in range(9)], [("a", 0.4, 1), ("b", 0.4, 1), ("none", 0.2, 1)]))
    assert s["a"].effective_target == s["b"].effective_target == 0.5 and s["none"].effective_target == 0.0 and s["a"].actual_share == 0.5


def test_uniform_is_even(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).select(mixing.uniform(17)).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and np.histogram(u, 10, (0, 1))[0].min() > 1800
