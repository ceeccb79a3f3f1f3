import random

import numpy as np
import pytest

from epistrata.operators import quantiles


@pytest.mark.parametrize("held", [10**6, 40])
def test_equals_numpy(spark, held):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(5))) for _ in range(500)] + [(None, rng.random()) for _ in range(200)] + [("c", 3.0), ("d", None), ("d", float("nan"))]
    rows += [("e", 1.0)] * 2000 + [("e", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "k string, x double")
    qs = [0.0, 0.013, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, ["k"], "x", qs, held).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for k in got:
        xs = [x for g, x in rows if g == k and x is not None and x == x]
        assert np.allclose(got[k], np.quantile(xs, qs), atol=1e-12)


def test_no_keys_and_no_rows(spark):
    df = spark.range(11).selectExpr("cast(id as double) as x")
    assert quantiles.exact_quantiles(df, [], "x", [0.25]).first()["q"] == [2.5]
    assert quantiles.exact_quantiles(spark.range(1000).selectExpr("cast(id as double) as x"), [], "x", [0.25], 20).first()["q"] == [249.75]
    assert quantiles.exact_quantiles(df.withColumn("k", df.x).limit(0), ["k"], "x", [0.5]).count() == 0


def test_a_sketch_that_places_nothing(spark, monkeypatch):
    """Brackets no sketch narrows are halved until they can be held; no task is given the rest."""
    from epistrata.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 1)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=400) * 1e-300, rng.normal(size=400) * 1e200, [0.0] * 50, np.arange(200.0)])
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    got = quantiles.exact_quantiles(df, ["k"], "x", [0.37], held=300).first()["q"]
    want = np.quantile(x, [0.37])
    assert all(abs(a - b) <= 1e-9 * max(abs(b), 1e-290) for a, b in zip(got, want))
