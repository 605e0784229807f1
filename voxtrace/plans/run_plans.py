"""Queries over run bookkeeping and rubric scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.functions.student_t import mean_half_width_sql
from voxtrace.operators import runs as run_ops
from voxtrace.operators import scoring
from voxtrace.operators.ordered import dealt
from voxtrace.plans.views_sql import RUNS
from voxtrace.session import staging_path
from voxtrace.sources.tables import table, order_runs


def _runs(spark, sf_dir):
    done = run_ops.completion_status(F.col("status"), F.lit(False), F.lit(False))
    return order_runs(spark, sf_dir).withColumn("completion", done)


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("task_id"), F.col("c_nationkey").cast("bigint").alias("source_id")
    )


def _points(spark, sf_dir, runs=None, carried=()):
    """Points of every run; failed evaluations leave no tool criteria, passed ones skip artifacts."""
    rows = ", ".join(
        f"named_struct('section', '{section}', 'criterion_id', '{code}_{label}', "
        f"'earned', CASE WHEN pmod(run_id + {i}, 3) > 0 THEN 1 ELSE 0 END)"
        for i, (section, code, label, _) in enumerate(scoring.RUBRIC)
    )
    every = order_runs(spark, sf_dir)
    scored = every.selectExpr("run_id", "status", f"inline(array({rows}))").where(
        (F.col("status") != "error") | (F.col("section") != "tools")
    )
    skipped = every.where("status = 'passed'").select("run_id", F.lit("artifacts").alias("section"))
    return scoring.run_points(every if runs is None else runs, scored, skipped, carried)


def _scored(spark, sf_dir):
    return scoring.criteria_of(_points(spark, sf_dir))


def score_rollup(spark, sf_dir):
    return scoring.roll_up(_points(spark, sf_dir))


def score_sink(spark, sf_dir):
    """Score rows written as Parquet by section and read back."""
    path = staging_path(spark, "scores")
    # a task sorts its rows by section, so runs are dealt anew before each becomes a row per criterion
    # (by run_id alone, as they come, the planner would drop the shuffle and fold its tasks)
    points = dealt(_points(spark, sf_dir), ["run_id", "points"])
    scoring.criteria_of(points).write.partitionBy("section").parquet(path)
    return spark.read.parquet(path).groupBy("section", "criterion_id").agg(
        F.sum("earned").alias("earned"), F.count("*").alias("runs")
    )


def task_status(spark, sf_dir):
    return scoring.task_status(order_runs(spark, sf_dir), ["task_id"])


def batch_summary(spark, sf_dir):
    totals = _scored(spark, sf_dir).groupBy("run_id").agg(
        F.sum("earned").alias("earned"), F.sum("max").alias("max")
    )
    runs = order_runs(spark, sf_dir).join(totals, "run_id")
    return scoring.batch_summary(
        runs.withColumn("batch", F.year("batch_time").cast("bigint")), ["batch"]
    )


def latest_run(spark, sf_dir):
    return run_ops.latest_runs(_tasks(spark, sf_dir), _runs(spark, sf_dir)).drop("source_id")


def status_rows(spark, sf_dir):
    """Status of each customer's orders as runs, with the files they left."""
    runs = order_runs(spark, sf_dir).selectExpr(
        "cast(task_id AS string) AS task_id",
        "concat('bench_', date_format(batch_time, 'dd-MM-yyyy_HH-mm-ss')) AS batch",
        "concat(run_id, '_', task_id, '_run-', lower(hex(run_id))) AS run_folder",
        "CASE WHEN run_id % 7 = 0 THEN 'missing' END AS judge_error",
        "status AS judge_status",
        "run_id % 5 + 1 AS judge_score",
        "CASE WHEN run_id % 3 > 0 THEN 4 END AS judge_threshold",
        "CASE WHEN run_id % 11 = 0 THEN 'missing' END AS result_error",
        "CASE WHEN run_id % 4 > 0 THEN status END AS result_status",
        "CASE WHEN status <> 'error' THEN concat(run_id % 14, '/13') END AS score_label",
        "CASE WHEN status = 'passed' THEN run_id % 101 END AS score_percentage",
        "CASE WHEN status = 'error' THEN named_struct('type', 'Timeout', 'message', concat('run  ', run_id, '\\nended')) END AS first_error",
        "run_id % 2 = 0 AS has_summary",
    )
    tasks = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS question", "CASE WHEN c_nationkey < 10 THEN c_mktsegment END AS volume_relative_path"
    )
    runs = runs.withColumn("run_dir", F.concat_ws("/", "batch", "run_folder"))
    return run_ops.status_rows(tasks, runs, "customers")


def completion(spark, sf_dir):
    status = F.col("o_orderstatus")
    result = F.when(status == "F", "passed").when(
        status == "O", F.when(F.col("o_totalprice") > 200000, "error")
    ).otherwise("skipped")
    priority = F.col("o_orderpriority")
    judge = F.when(priority == "1-URGENT", "passed").when(priority == "2-HIGH", "failed").when(
        priority == "3-MEDIUM", "error"
    )
    rerun, indexed, outcome = run_ops.indexed_status(result, judge)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        run_ops.completion_status(result, priority == "4-NOT SPECIFIED", judge.isNotNull()).alias("completion"),
        run_ops.judge_outcome(judge).alias("judge_outcome"),
        rerun.alias("indexed_rerun"),
        indexed.alias("indexed_completion"),
        outcome.alias("indexed_outcome"),
    )


def batch_folders(spark, sf_dir):
    """Batch time and task id read from folder names."""
    stamp = F.date_format("o_orderdate", "dd-MM-yyyy_HH-mm-ss")
    batch = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("eval_"), stamp)).otherwise("eval")
    folder = F.concat(
        F.lit("007_"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "F", "_run-0af").otherwise("_run-xyz")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        run_ops.batch_time(batch).cast("string").alias("batch_time"),
        run_ops.task_of_folder(folder).alias("task_id"),
    )


def status_pivot(spark, sf_dir):
    latest = run_ops.latest_runs(_tasks(spark, sf_dir), _runs(spark, sf_dir))
    return run_ops.status_pivot(latest, "source_id")


def _index(spark, sf_dir):
    """Index of the customers outside one segment; the others are only specified."""
    customer = table(spark, sf_dir, "customer")
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    index = customer.where("c_mktsegment <> 'FURNITURE'").select(
        F.col("c_custkey").cast("string").alias("task_id"),
        F.when(segment == "BUILDING", F.lit(None).cast("boolean")).otherwise(balance > 0).alias("run_requested"),
        F.when(balance > 3000, F.concat(F.lit("runs/"), F.col("c_custkey"))).alias("path"),
    )
    specified = customer.where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("task_id")
    )
    return index, specified


def plan_runs(spark, sf_dir):
    index, specified = _index(spark, sf_dir)
    existing = table(spark, sf_dir, "customer").where("c_nationkey < 15").select(
        F.concat(F.lit("runs/"), F.col("c_custkey")).alias("path")
    )
    missing = run_ops.plan_runs(index, specified, existing)
    requested = run_ops.plan_runs(index, specified, existing, requested_only=True)
    return missing.withColumn("mode", F.lit("missing")).unionByName(
        requested.withColumn("mode", F.lit("requested"))
    )


def index_refresh(spark, sf_dir):
    index, specified = _index(spark, sf_dir)
    found = order_runs(spark, sf_dir).select(
        F.col("task_id").cast("string").alias("task_id"),
        F.date_format("batch_time", "yyyy-MM-dd").alias("batch"),
        F.col("run_id").cast("string").alias("folder"),
        F.concat(F.lit("new/"), F.col("run_id")).alias("path"),
    )
    return run_ops.refresh_index(run_ops.merge_index(index, specified), found)


def index_results(spark, sf_dir):
    index, specified = _index(spark, sf_dir)
    results = order_runs(spark, sf_dir).select(
        F.col("task_id").cast("string").alias("task_id"),
        "status",
        F.when(F.col("price") > 200000, F.concat(F.lit("new/"), F.col("run_id"))).alias("path"),
        F.col("run_id").alias("position"),
    )
    return run_ops.apply_results(run_ops.merge_index(index, specified), results)


def selectors(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("p_"), F.col("p_partkey")).alias("run_id"),
        F.col("p_name").alias("task_id"),
        F.col("p_type").alias("benchmark"),
    )
    return run_ops.select_runs(
        rows,
        exact=["p_11", "p_12"],
        run_patterns=["p_7?", "p_[12]00"],
        run_regexes=["99$"],
        task_patterns=["red b", "hot*r?d"],
        benchmark_patterns=["PRO"],
    ).select("p_partkey", "benchmark")


def score_fallback(spark, sf_dir):
    status, price = F.col("status"), F.col("price")
    known = status == "passed"
    rows = order_runs(spark, sf_dir).select(
        "run_id",
        F.when(known, F.pmod("run_id", F.lit(14))).alias("earned"),
        F.when(known & (price > 100000), 13).alias("max"),
        F.when(price > 50000, F.concat(F.pmod("run_id", F.lit(14)).cast("string"), F.lit("/13")))
        .when(price > 30000, "n/a").alias("label"),
        F.when(status == "failed", F.lit("0.25")).when(status == "error", F.lit("")).alias("percentage"),
    )
    return scoring.score_fallback(rows)


def _observed(spark, sf_dir):
    """Observations of completed runs with the benchmark file of their task."""
    runs = _runs(spark, sf_dir).where("completion = 'run_completed'").select("run_id", "task_id")
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("task_id"),
        F.concat(F.lower("c_mktsegment"), F.lit(".json")).alias("json_file"),
    )
    named = runs.join(files, "task_id").select("run_id", "json_file")
    return scoring.observations(_points(spark, sf_dir, named, ["json_file"]))


def bench_agg(spark, sf_dir):
    return scoring.benchmark_aggregates(_observed(spark, sf_dir))


def macro_mean(spark, sf_dir):
    return scoring.across_files(_observed(spark, sf_dir))


LABELS = {"building": "structures", "machinery": "structures", "household": "home"}


def pooled(spark, sf_dir):
    return scoring.pooled_labels(_observed(spark, sf_dir), LABELS)


def bounded_err(spark, sf_dir):
    rows = scoring.benchmark_aggregates(_observed(spark, sf_dir))
    shown = scoring.bounded_errors(rows)
    return shown.select(
        "json_file", "section", "percentage", F.round("error_low", 4).alias("error_low"),
        F.round("error_high", 4).alias("error_high"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        score_rollup, score_sink, task_status, batch_summary, latest_run, status_rows, completion,
        batch_folders, status_pivot, plan_runs, index_refresh, index_results, selectors,
        score_fallback, bench_agg, macro_mean, pooled, bounded_err,
    )
}

_RUBRIC = ", ".join(
    f"({i}, '{s}', '{code}_{label}', '{code[0]}', '{category}')"
    for i, (s, code, label, category) in enumerate(scoring.RUBRIC)
)
CRITERIA = f"""{RUNS}, rubric(i, section, criterion_id, dimension, category) AS (VALUES {_RUBRIC}),
  criteria AS (SELECT run_id, task_id, status, batch_time, section, criterion_id, dimension, category,
      (CASE WHEN status = 'passed' AND section = 'artifacts' THEN 1
        WHEN status = 'error' AND section = 'tools' THEN 0
        WHEN (run_id + i) % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS earned, 1::BIGINT AS max FROM runs, rubric)"""
OBSERVED = f"""{CRITERIA}, filed AS (SELECT criteria.*, lower(c_mktsegment) || '.json' AS json_file
    FROM criteria JOIN customer ON task_id = c_custkey WHERE status <> 'error'),
  long AS (SELECT json_file, run_id, earned, max, 'file' AS section_type, 'all' AS section FROM filed
    UNION ALL SELECT json_file, run_id, earned, max, 'dimension', dimension FROM filed
    UNION ALL SELECT json_file, run_id, earned, max, 'category', category FROM filed
    UNION ALL SELECT json_file, run_id, earned, max, 'criterion', criterion_id FROM filed),
  observed AS (SELECT json_file, run_id, section_type, section, sum(earned) AS earned, sum(max) AS max,
      sum(earned) / sum(max) AS share FROM long GROUP BY ALL),
  stored AS (SELECT *, CASE section_type WHEN 'file' THEN share ELSE round_even(share, 4) END AS kept FROM observed)"""


def _pool_sql(source: str, keys: str, share: str) -> str:
    return f"""SELECT {keys}, sum(earned)::BIGINT AS earned, sum(max)::BIGINT AS max, count(*) AS n_observations,
      round_even(sum(earned) / sum(max), 4) AS percentage,
      {mean_half_width_sql("count(*)", f"stddev_samp({share})")} AS ci95 FROM {source} GROUP BY {keys}"""


PER_FILE = _pool_sql("observed", "json_file, section_type, section", "share")
INDEX = """cust AS (SELECT c_custkey::VARCHAR AS task_id, *, 'runs/' || c_custkey AS folder FROM customer),
  idx AS (SELECT task_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal > 0 END AS run_requested,
      CASE WHEN c_acctbal > 3000 THEN folder END AS path FROM cust WHERE c_mktsegment <> 'FURNITURE'),
  merged AS (SELECT * FROM idx UNION ALL SELECT task_id, true, NULL FROM cust WHERE c_mktsegment = 'FURNITURE')"""
LATEST = f"""{RUNS}, latest AS (SELECT c_custkey AS task_id, c_nationkey::BIGINT AS source_id,
    arg_max(run_id, epoch(batch_time)::BIGINT * 100000000 + run_id) AS latest_run,
    arg_max(run_id, epoch(batch_time)::BIGINT * 100000000 + run_id) FILTER (status <> 'error') AS latest_completed_run,
    arg_max(status, epoch(batch_time)::BIGINT * 100000000 + run_id) AS s, count(run_id) AS present_runs,
    count(run_id) FILTER (status <> 'error') AS completed_runs
  FROM customer LEFT JOIN runs ON c_custkey = task_id GROUP BY ALL),
  latest_status AS (SELECT *, CASE WHEN s IS NULL THEN 'missing_run' WHEN s = 'error' THEN 'run_error'
    ELSE 'run_completed' END AS run_completion_status, CASE WHEN s IS NULL THEN 'missing_run'
    WHEN s = 'error' THEN 'run_error' ELSE 'passed' END AS rerun_status FROM latest)"""

ORACLES = {
    "score_rollup": f"""WITH {CRITERIA} SELECT run_id, CASE WHEN grouping(section) = 0 THEN 'section'
        WHEN grouping(category) = 0 THEN 'category' WHEN grouping(dimension) = 0 THEN 'dimension' ELSE 'total' END AS level,
      coalesce(section, category, dimension, 'all') AS name, sum(earned)::BIGINT AS earned, sum(max)::BIGINT AS max,
      round_even(sum(earned) / sum(max), 4) AS percentage FROM criteria
      GROUP BY GROUPING SETS ((run_id, section), (run_id, category), (run_id, dimension), (run_id))""",
    "score_sink": f"""WITH {CRITERIA} SELECT section, criterion_id, sum(earned)::BIGINT AS earned, count(*) AS runs
      FROM criteria GROUP BY ALL""",
    "task_status": f"""WITH {RUNS} SELECT task_id, CASE max(CASE status WHEN 'passed' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END)
      WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'error' END AS status, count(*) AS sections FROM runs GROUP BY task_id""",
    "batch_summary": f"""WITH {CRITERIA}, t AS (SELECT run_id, status, year(batch_time) AS batch, sum(earned) AS e,
        sum(max) AS m FROM criteria GROUP BY ALL)
      SELECT batch, count(*) AS n_tasks, count(*) FILTER (status = 'passed') AS n_passed,
        count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'error') AS n_errors,
        sum(e)::BIGINT AS earned, sum(m)::BIGINT AS max, round_even(sum(e) / sum(m), 4) AS percentage,
        sum(e)::BIGINT || '/' || sum(m)::BIGINT AS label FROM t GROUP BY batch""",
    "latest_run": f"""WITH {LATEST} SELECT task_id, latest_run, latest_completed_run, run_completion_status, rerun_status,
      present_runs, completed_runs FROM latest_status""",
    "status_rows": f"""WITH {RUNS}, r AS (SELECT task_id, run_id, batch_time, status,
        'bench_' || strftime(batch_time, '%d-%m-%Y_%H-%M-%S') AS batch,
        run_id || '_' || task_id || '_run-' || lower(to_hex(run_id)) AS folder, run_id % 7 > 0 AS judged,
        run_id % 11 > 0 AS finished, CASE WHEN run_id % 4 > 0 AND run_id % 11 > 0 THEN status END AS result FROM runs),
      d AS (SELECT *, batch || '/' || folder AS dir, CASE WHEN result IN ('passed', 'failed') THEN 'run_completed'
          WHEN NOT finished OR result = 'error' THEN 'run_error'
          WHEN run_id % 2 = 0 OR judged THEN 'run_completed' ELSE 'run_error' END AS done,
        CASE WHEN judged THEN 'judge_response.json.status=''' || status || ''' | judge_response.json.raw_score_1_to_5=' || (run_id % 5 + 1)
            || CASE WHEN run_id % 3 > 0 THEN ' | judge_response.json.pass_threshold_1_to_5=4' ELSE '' END
          ELSE 'judge_response.json=missing' END || ' | ' ||
        CASE WHEN finished THEN 'result.json.status=' || coalesce('''' || result || '''', 'None')
            || CASE WHEN status <> 'error' THEN ' | result.json.score.label=''' || (run_id % 14) || '/13''' ELSE '' END
            || CASE WHEN status = 'passed' THEN ' | result.json.score.percentage=' || (run_id % 101) ELSE '' END
            || CASE WHEN status = 'error' THEN ' | result.json.errors[0]=Timeout: run ' || run_id || ' ended' ELSE '' END
          ELSE 'result.json=missing' END AS proof FROM r),
      n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY batch_time DESC, folder DESC) AS back,
        row_number() OVER (PARTITION BY task_id, done ORDER BY batch_time DESC, folder DESC) AS done_back,
        count(*) OVER (PARTITION BY task_id) AS present,
        count(*) FILTER (done = 'run_completed') OVER (PARTITION BY task_id) AS completed FROM d),
      l AS (SELECT * FROM n WHERE back = 1), c AS (SELECT * FROM n WHERE done = 'run_completed' AND done_back = 1)
      SELECT coalesce(CASE l.done WHEN 'run_completed' THEN 'passed' ELSE l.done END, 'missing_run') AS rerun_status,
        coalesce(l.done, 'missing_run') AS run_completion_status,
        CASE WHEN l.judged AND l.status <> 'error' THEN 'judge_' || l.status ELSE 'judge_unavailable' END AS judge_outcome,
        c_custkey::VARCHAR AS task_id, c_custkey::VARCHAR AS source_task_id, c_name AS question,
        CASE WHEN c_nationkey < 10 THEN c_mktsegment ELSE '' END AS variant_path,
        coalesce(l.batch, '') AS latest_batch, coalesce(l.folder, '') AS latest_run_folder,
        CASE WHEN l.judged THEN l.status ELSE '' END AS latest_judge_status, coalesce(l.result, '') AS latest_result_status,
        CASE WHEN l.judged THEN (l.run_id % 5 + 1)::VARCHAR ELSE '' END AS latest_judge_raw_score_1_to_5,
        CASE WHEN l.judged AND l.run_id % 3 > 0 THEN '4' ELSE '' END AS latest_judge_pass_threshold_1_to_5,
        CASE WHEN l.finished AND l.status <> 'error' THEN (l.run_id % 14) || '/13' ELSE '' END AS latest_result_score_label,
        CASE WHEN l.finished AND l.status = 'passed' THEN (l.run_id % 101)::VARCHAR ELSE '' END AS latest_result_score_percentage,
        coalesce(l.present, 0) AS present_run_count, coalesce(l.completed, 0) AS completed_run_count,
        coalesce(c.batch, '') AS latest_completed_batch, coalesce(c.folder, '') AS latest_completed_run_folder,
        coalesce(l.proof, 'No present run folder matched this expanded customers.json task_id.') AS proof,
        coalesce(l.dir, '') AS latest_run_dir, coalesce(c.dir, '') AS latest_completed_run_dir
      FROM customer LEFT JOIN l ON l.task_id = c_custkey LEFT JOIN c ON c.task_id = c_custkey""",
    "completion": """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O'
          THEN CASE WHEN o_totalprice > 200000 THEN 'error' END ELSE 'skipped' END AS r,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'passed' WHEN '2-HIGH' THEN 'failed' WHEN '3-MEDIUM' THEN 'error' END AS j
        FROM orders), d AS (SELECT *, coalesce(r IN ('passed', 'failed') AND j IN ('passed', 'failed'), false) AS done FROM o)
      SELECT o_orderkey, CASE WHEN r = 'passed' THEN 'run_completed' WHEN r = 'error' OR r IS NULL THEN 'run_error'
          WHEN o_orderpriority <> '5-LOW' THEN 'run_completed' ELSE 'run_error' END AS completion,
        CASE j WHEN 'passed' THEN 'judge_passed' WHEN 'failed' THEN 'judge_failed' ELSE 'judge_unavailable' END AS judge_outcome,
        CASE WHEN done THEN 'passed' ELSE 'run_error' END AS indexed_rerun, 'run_completed' AS indexed_completion,
        CASE WHEN done THEN 'judge_passed' ELSE 'judge_unavailable' END AS indexed_outcome FROM d""",
    "batch_folders": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::VARCHAR END AS batch_time,
      CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS task_id FROM orders""",
    "status_pivot": f"""WITH {LATEST} SELECT source_id, count(*) FILTER (rerun_status = 'passed') AS passed,
      count(*) FILTER (rerun_status = 'run_error') AS run_error, count(*) FILTER (rerun_status = 'missing_run') AS missing_run,
      count(*) AS total FROM latest_status GROUP BY source_id""",
    "plan_runs": f"""WITH {INDEX}, spec AS (SELECT merged.*, c_nationkey FROM merged JOIN cust USING (task_id)
        WHERE c_mktsegment <> 'MACHINERY' AND coalesce(run_requested, true))
      SELECT task_id, 'missing' AS mode FROM spec WHERE path IS NULL OR c_nationkey >= 15
      UNION ALL SELECT task_id, 'requested' FROM spec""",
    "index_refresh": f"""WITH {INDEX}, {RUNS}, f AS (SELECT task_id::VARCHAR AS task_id, 'new/' || arg_max(run_id::VARCHAR,
        strftime(batch_time, '%Y-%m-%d') || run_id::VARCHAR) AS found FROM runs GROUP BY task_id)
      SELECT task_id, CASE WHEN found IS NOT NULL THEN false ELSE run_requested END AS run_requested,
        coalesce(found, path) AS path FROM merged LEFT JOIN f USING (task_id)""",
    "index_results": f"""WITH {INDEX}, {RUNS}, f AS (SELECT task_id::VARCHAR AS task_id, max_by(CASE WHEN price > 200000
          THEN 'new/' || run_id ELSE '' END, run_id) AS found FROM runs WHERE status <> 'error' GROUP BY task_id)
      SELECT task_id, CASE WHEN found IS NOT NULL THEN false ELSE run_requested END AS run_requested,
        coalesce(nullif(found, ''), path) AS path FROM merged LEFT JOIN f USING (task_id)""",
    "selectors": """SELECT p_partkey, p_type AS benchmark FROM part WHERE p_partkey IN (11, 12)
      OR p_partkey BETWEEN 70 AND 79 OR p_partkey IN (100, 200) OR p_partkey % 100 = 99
      OR p_name LIKE '%red b%' OR p_name LIKE 'hot%r_d' OR p_type LIKE '%PRO%'""",
    "score_fallback": f"""WITH {RUNS}, r AS (SELECT *, status = 'passed' AND price > 100000 AS fields,
        price > 50000 AS labelled FROM runs)
      SELECT run_id, CASE WHEN fields OR labelled THEN (run_id % 14)::DOUBLE WHEN status = 'failed' THEN 0.25 ELSE 0 END AS earned,
        CASE WHEN fields OR labelled THEN 13.0::DOUBLE ELSE 1 END AS max,
        round_even(CASE WHEN fields OR labelled THEN run_id % 14 / 13 WHEN status = 'failed' THEN 0.25::DOUBLE ELSE 0 END, 4) AS percentage
      FROM r""",
    "bench_agg": f"WITH {OBSERVED} {PER_FILE}",
    "macro_mean": f"""WITH {OBSERVED}, per_file AS ({PER_FILE}),
      pool AS ({_pool_sql("stored", "section_type, section", "kept")}),
      files AS (SELECT section_type, section, count(*) AS n_json_files, round_even(avg(percentage), 4) AS macro_mean,
        {mean_half_width_sql("count(*)", "stddev_samp(percentage)")} AS ci95_across_files FROM per_file GROUP BY ALL)
      SELECT * FROM pool JOIN files USING (section_type, section)""",
    "pooled": f"""WITH {OBSERVED}, named AS (SELECT * REPLACE (CASE json_file WHEN 'building.json' THEN 'structures.json'
        WHEN 'machinery.json' THEN 'structures.json' WHEN 'household.json' THEN 'home.json' ELSE json_file END AS json_file)
        FROM stored) {_pool_sql("named", "json_file, section_type, section", "kept")}""",
    "bounded_err": f"""WITH {OBSERVED}, per_file AS ({PER_FILE}) SELECT json_file, section, percentage,
      round(least(ci95, percentage), 4) AS error_low, round(least(ci95, 1 - percentage), 4) AS error_high
      FROM per_file""",
}
