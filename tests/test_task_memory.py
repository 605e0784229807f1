"""Steps whose tasks must stay small on large tables."""

from voxtrace.functions import payload
from voxtrace.operators.ordered import dealt
from voxtrace.plans import run_plans


def test_score_rows_are_dealt_anew_before_the_sink(spark, sf_dir, capsys):
    """A shuffle by run alone is dropped, as runs come that way, and then folded into few tasks."""
    dealt(run_plans._points(spark, sf_dir), ["run_id"]).explain()
    assert "REPARTITION_BY_NUM" not in capsys.readouterr().out
    seen = []
    real = run_plans.dealt
    run_plans.dealt = lambda df, columns: seen.append(real(df, columns)) or seen[-1]
    try:
        rows = run_plans.score_sink(spark, sf_dir).collect()
    finally:
        run_plans.dealt = real
    seen[0].explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out and len(rows) == 13


def test_payloads_reach_python_in_small_batches(spark, capsys):
    """Arrow batches would hold ten thousand payloads, however long."""
    rows = spark.createDataFrame([('{"a": [1, 2]}',), ("no json",), (None,)], "p string")
    small = rows.select(payload.reduce_payload(rows["p"]).alias("s"))
    small.explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert [r["s"] for r in small.collect()] == ['{"a": [1, 2]}', "no json", None]
