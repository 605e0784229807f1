"""Bracketed percentiles: ties, gaps, missing values, many groups and values that are not finite."""

import numpy as np
import pytest

from voxtrace.operators import quantiles
from voxtrace.operators.quantiles import exact_percentiles

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]


def columns_of(rng, n):
    return {
        "uniform": rng.random(n),
        "ties": rng.integers(0, 5, n).astype(float),
        "outlier": np.append(rng.random(n - 1), 1e12),
        "powers": 10.0 ** rng.integers(-12, 12, n),
        "constant": np.full(n, 2.5),
        "negative": -np.exp(rng.normal(0, 8, n)),
        "few": np.append(np.full(n - 2, np.nan), [3.0, 7.0]),
    }


def table(spark, data):
    rows = zip(*[[None if np.isnan(v) else float(v) for v in values] for values in data.values()], strict=True)
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` double" for c in data))


def check(got, data, probabilities):
    found = {r["column"]: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == data.keys()
    for c, values in data.items():
        want = np.percentile(values[~np.isnan(values)], [100 * p for p in probabilities])
        assert found[c] == pytest.approx(want, rel=1e-12), c


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (7, 4), (64, 50)])
def test_columns_match_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "SORTED", few)
    monkeypatch.setattr(quantiles, "ROUNDS", 40)
    data = columns_of(np.random.default_rng(bins), 3000)
    df = table(spark, data)
    got = quantiles._bracketed(df, [], list(data), PROBABILITIES)
    assert got is not None
    check(got, data, PROBABILITIES)
    check(quantiles._ranked(df, [], list(data), PROBABILITIES), data, PROBABILITIES)


def test_groups_with_missing_and_odd_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 7 == 3 else f"k{k % 7}", float(rng.normal()), None if k % 2 else float(k)) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, `a.b` double, c double")
    got = {(r["key"], r["column"]): (r.p0, r.p1) for r in exact_percentiles(df, ["key"], ["a.b", "c"], [0.5, 0.1]).collect()}
    for key in {r[0] for r in rows}:
        for i, c in ((1, "a.b"), (2, "c")):
            values = [r[i] for r in rows if r[0] == key and r[i] is not None]
            assert got[key, c] == pytest.approx(tuple(np.percentile(values, [50, 10])))
    assert len(got) == 14


def test_what_brackets_leave_is_ranked(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GROUPS", 3)
    df = spark.createDataFrame([(k % 50, float(k)) for k in range(1000)], "k int, v double")
    assert quantiles._bracketed(df, ["k"], ["v"], [0.5]) is None
    got = {r.k: r.p0 for r in exact_percentiles(df, ["k"], ["v"], [0.5]).collect()}
    assert got == {k: k + 475.0 for k in range(50)}
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (3.0,)], "v double")
    assert exact_percentiles(odd, [], ["v"], [0.0, 0.5]).head()[1:] == (1.0, 2.5)
    monkeypatch.setattr(quantiles, "SORTED", 1)
    monkeypatch.setattr(quantiles, "ROUNDS", 2)
    spread = spark.createDataFrame([(2.0**k,) for k in range(-500, 501)], "v double")
    assert quantiles._bracketed(spread, [], ["v"], [0.4]) is None
    assert exact_percentiles(spread, [], ["v"], [0.4]).head().p0 == 2.0**-100


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert [tuple(r) for r in exact_percentiles(df, [], ["a", "b"], [0.5]).collect()] == [("b", 2.0)]
    assert exact_percentiles(df.where("b > 9"), [], ["a", "b"], [0.5]).count() == 0
    assert exact_percentiles(df, [], [], [0.5]).columns == ["column", "p0"]
