"""Ordered helpers and exact percentiles against plain Python, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtrace.operators.ordered import (
    carry_forward,
    next_value,
    row_numbers,
    running_total,
    salted_lookup,
)
from voxtrace.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 40, 3000))
    data = pd.DataFrame({"k": keys, "o": rng.permutation(3000), "w": rng.integers(0, 5, 3000)})
    data["mark"] = np.where(rng.random(3000) < 0.2, data["o"], np.nan)
    return data


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame).withColumn(
        "mark", F.when(~F.isnan("mark"), F.col("mark").cast("bigint"))
    )
    # Several slices even on small input: adaptive execution would fold them into one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield df
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_total_and_numbers(table, frame):
    got = running_total(table, ["k"], ["o"], F.col("w"), "sum", total="all").toPandas()
    ordered = frame.sort_values(["k", "o"]).reset_index(drop=True)
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    assert (got["sum"] == ordered.groupby("k")["w"].cumsum()).all()
    assert (got["all"] == ordered.groupby("k")["w"].transform("sum")).all()
    numbered = row_numbers(table, [], ["k", "o"]).toPandas().sort_values(["k", "o"])
    assert numbered["rn"].tolist() == list(range(1, 3001))


def test_next_value_and_carry_forward(table, frame):
    ordered = frame.sort_values(["k", "o"]).reset_index(drop=True)
    got = next_value(table, ["k"], ["o"], "o", "following").toPandas()
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    want = ordered.groupby("k")["o"].shift(-1)
    assert got["following"].fillna(-1).tolist() == want.fillna(-1).tolist()
    got = carry_forward(table, ["k"], ["o"], "mark", "last").toPandas()
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    want = ordered.groupby("k")["mark"].ffill()
    assert got["last"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_percentiles_match_numpy(table, frame):
    got = exact_percentiles(table, ["k"], ["w", "o"], [0.0, 0.3, 0.5, 0.99, 1.0]).toPandas()
    for row in got.itertuples():
        values = frame.loc[frame["k"] == row.k, row.column]
        want = np.percentile(values, [0, 30, 50, 99, 100])
        assert np.allclose([row.p0, row.p1, row.p2, row.p3, row.p4], want)


def test_percentiles_ignore_missing(spark):
    df = spark.createDataFrame([(None,), (1.0,), (4.0,)], "v double")
    row = exact_percentiles(df, [], ["v"], [0.5]).head()
    assert row["p0"] == 2.5
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_percentiles(empty, [], ["v"], [0.5]).count() == 0


def test_salted_lookup_keeps_every_row(table, spark):
    names = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("name"))
    inner = salted_lookup(table, names, ["k"], ["o"])
    left = salted_lookup(table, names, ["k"], ["o"], "left")
    assert inner.count() == table.where("k < 20").count()
    assert left.count() == 3000
    assert left.where("name is null").count() == table.where("k >= 20").count()


def test_salted_lookup_broadcasts_no_copies(spark, tmp_path, capsys):
    """A small file counts its rows once, the look-up holds each sixteen times."""
    names = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("name"))
    names.write.parquet(str(tmp_path / "names"))
    rows = spark.range(0, 500).select((F.col("id") % 30).alias("k"), F.col("id").alias("o"))
    for how in ("inner", "left"):
        salted_lookup(rows, spark.read.parquet(str(tmp_path / "names")), ["k"], ["o"], how).explain()
        assert "Broadcast" not in capsys.readouterr().out
