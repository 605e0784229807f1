"""Traps of table audits: missing values, booleans, single rows, text cells, t quantiles."""

import math

import pytest
from pyspark.sql import functions as F

from voxtrace.functions import student_t
from voxtrace.operators import audit
from voxtrace.operators.audit import Condition
from voxtrace.sources.csv_table import read_csv_table


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [("a", 1.0, True, None), ("a", None, False, None), (None, 3.0, True, None), ("b", 5.0, None, None)]
    return spark.createDataFrame(rows, "g string, v double, flag boolean, none double")


def test_column_selection_and_structure(mixed):
    assert audit.select_columns(mixed) == ["v", "none"]
    with pytest.raises(ValueError, match="Unknown CSV columns"):
        audit.select_columns(mixed, ["v", "zz"])
    missing = {r["column"]: r["missing"] for r in audit.missing_columns(mixed).collect()}
    assert missing == {"g": 1, "v": 1, "flag": 1, "none": 4}


def test_aggregates_of_missing_text_and_boolean_columns(mixed):
    ops = ("count", "missing", "mean", "std", "min", "max", "median", "sum")
    rows = {r["column"]: r for r in audit.column_aggregates(mixed, ["v", "flag", "none", "g"], ops).collect()}
    assert (rows["v"]["count"], rows["v"]["sum"], rows["v"]["median"]) == (3, 9.0, 3.0)
    assert rows["none"]["sum"] == 0.0 and rows["none"]["mean"] is None
    assert math.isclose(rows["flag"]["mean"], 2 / 3)
    assert rows["g"]["count"] == 3 and rows["g"]["sum"] is None and rows["g"]["min"] is None


def test_groups_with_missing_key_single_row_std_and_cap(mixed):
    rows = audit.grouped_aggregates(
        mixed, ["g"], ["v"], ("count", "std", "median", "sum"), max_groups=2
    ).collect()
    assert [r["g"] for r in rows] == ["a", "b"] and all(r["truncated"] for r in rows)
    assert rows[0]["std_v"] is None and rows[0]["rows"] == 2
    every = audit.grouped_aggregates(mixed, ["g"], ["v"], ("count", "median")).collect()
    assert {r["g"] for r in every} == {"a", "b", None} and not any(r["truncated"] for r in every)
    assert {r["g"]: r["median_v"] for r in every} == {"a": 1.0, "b": 5.0, None: 3.0}
    with pytest.raises(ValueError):
        audit.grouped_aggregates(mixed, ["g"], ["v"], max_groups=0)


def test_conditions(mixed):
    conditions = [
        Condition("ne", "v", "!=", 1), Condition("none", "none", ">", 0), Condition("txt", "g", "eq", "a"),
    ]
    rows = {r["name"]: r for r in audit.conditional_counts(mixed, conditions).collect()}
    assert (rows["ne"]["count"], rows["ne"]["valid_count"], rows["ne"]["missing_excluded"]) == (2, 3, 1)
    assert rows["none"]["fraction"] is None
    assert rows["txt"]["count"] == 2
    for bad in (
        [Condition("a", "v", ">", 1), Condition("a", "v", "<", 1)],
        [Condition("a", "g", ">", "x")],
        [Condition("a", "v", ">", "x")],
        [Condition("a", "zz", ">", 1)],
    ):
        with pytest.raises(ValueError):
            audit.conditional_counts(mixed, bad)


def test_conditions_as_written(spark):
    df = spark.createDataFrame([(1.0, "a", True), (5.0, "b", False), (None, "7", None)], "`Volume [um3]` double, g string, `is ok` boolean")
    given = [
        "volume um3 >= 2", "g != '7'", "is_ok == true", {"column": "VOLUME_UM3", "gt": 0, "lt": 5, "name": "v"},
        {"column": "g", "op": "EQ", "value": "a"}, Condition("plain", "g", "==", "b"),
    ]
    counts = {r["name"]: (r["count"], r["valid_count"]) for r in audit.count_conditions(df, given).collect()}
    assert counts == {
        "volume um3 >= 2": (1, 2), "g != '7'": (2, 3), "is_ok == true": (1, 2), "v > 0": (2, 2), "v < 5": (1, 2),
        "g == a": (1, 3), "plain": (1, 3),
    }
    chosen = audit.parse_conditions({"a>=-2": True, "b < 3": False, "c<=x y": 1})
    assert [(c.column, c.op, c.value) for c in chosen] == [("a", ">=", -2), ("c", "<=", "x y")]
    assert audit.count_conditions(df, None).count() == 0
    twice = spark.createDataFrame([(1, 2)], "`a b` int, ab int")
    for frame, bad in (
        (df, ["volume"]), (df, ["> 5"]), (df, ["g >"]), (df, ["zz > 1"]), (twice, ["A_B > 1"]), (df, [{"gt": 1}]),
        (df, [{"column": "g", "op": "like", "value": "a"}]), (df, [{"column": "g"}]), (df, [5]),
    ):
        with pytest.raises(ValueError):
            audit.count_conditions(frame, bad)


def test_preview_turns_infinity_into_null(spark):
    df = spark.createDataFrame([(2, float("inf")), (1, 4.0), (3, float("nan"))], "k int, v double")
    assert [r["v"] for r in audit.preview(df, ["k"], 3).collect()] == [4.0, None, None]


def test_overall_statistics_of_large_neighbouring_values(spark):
    df = spark.createDataFrame([(1e9,), (1e9 + 1,), (1e9 + 2,)], "v double")
    row = audit.overall_statistics(df, [], F.col("v")).head()
    assert row["count"] == 3 and math.isclose(row["std"], math.sqrt(2 / 3), rel_tol=1e-9)


def test_list_statistics_of_one_value(spark):
    df = spark.createDataFrame([(1, [4.0]), (2, [1.0, 2.0, 4.0, 9.0])], "id int, v array<double>")
    one, four = audit.list_statistics(df, "v").orderBy("id").collect()
    assert one["stdev"] is None and one["pstdev"] == 0.0 and one["median"] == 4.0
    assert four["median"] == 3.0 and math.isclose(four["variance"], 38 / 3)


def test_python_modulo(spark):
    pairs = [(7.0, 3.0), (-7.0, 3.0), (7.0, -3.0), (-7.0, -3.0), (1.0, 0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in df.select(audit.python_modulo(F.col("a"), F.col("b"))).collect()]
    assert got == [a % b if b else None for a, b in pairs]


def test_t_quantiles():
    # Published table values.
    for df, want in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227)):
        assert math.isclose(student_t.t_quantile(0.975, df), want, abs_tol=1e-4)
    z, terms = student_t.expansion_terms(0.975)
    series = z + sum(c / 41**p for p, c in enumerate(terms, 1))
    assert math.isclose(series, student_t.t_quantile(0.975, 41), rel_tol=1e-7)


def test_interval_needs_two_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    rows = {r["k"]: r for r in audit.mean_interval(df, ["k"], "v").collect()}
    assert rows["a"]["half_width"] == 0.0
    assert math.isclose(rows["b"]["half_width"], 12.7062, abs_tol=1e-4)


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,d,s,b,e\n1,NA,x,True,\n2,1.5,NA,False,nan\n,2,z,,\n")
    df = read_csv_table(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "s": "string", "b": "boolean", "e": "double"}
    assert df.where("i is null").count() == 1 and df.where("d is null").count() == 1
    with pytest.raises(ValueError):
        read_csv_table(spark, str(tmp_path / "t.txt"))
