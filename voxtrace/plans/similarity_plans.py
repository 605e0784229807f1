"""Queries over block similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.operators import similarity as sim
from voxtrace.plans.views_sql import LIBRARY
from voxtrace.session import stage
from voxtrace.sources.tables import block_library, block_rows, table

TWO = ["quantity", "discount"]
THREE = ["quantity", "discount", "tax"]
FOUR = ["quantity", "discount", "tax", "price"]


def _stats(spark, sf_dir, features=TWO):
    return sim.block_statistics(block_rows(spark, sf_dir), "block_id", features)


def _library_stats(spark, sf_dir, features=TWO):
    stats = _stats(spark, sf_dir, features).where(F.col("n") >= sim.MIN_ROWS)
    return stats.join(block_library(spark, sf_dir), "block_id")


def block_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "block_id",
        "n",
        F.round(F.get("mean", F.lit(0)), 6).alias("mean_0"),
        F.round(F.get("mean", F.lit(1)), 6).alias("mean_1"),
        F.round(F.get("cov", F.lit(0)), 5).alias("cov_00"),
        F.round(F.get("cov", F.lit(1)), 6).alias("cov_01"),
        F.round(F.get("cov", F.lit(2)), 6).alias("cov_10"),
        F.round(F.get("cov", F.lit(3)), 6).alias("cov_11"),
    )


# 22 features of an order line: quantity, discount, tax and price in thousands, their squares and
# products, square roots, logarithms and the line's number.
_BASE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice / 1000"]
LINE_FEATURES = [
    *_BASE,
    *[f"({a}) * ({b})" for i, a in enumerate(_BASE) for b in _BASE[i:]],
    *[f"sqrt({a})" for a in _BASE],
    *[f"ln(1 + {a})" for a in _BASE[:3]],
    "l_linenumber",
]


def block_moments(spark, sf_dir):
    """Mean and shrunk covariance of 22 features for the lines of each supplier's remainder by 64."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 64).cast("bigint").alias("block"),
        *[F.expr(f"cast({f} AS double)").alias(f"f{i}") for i, f in enumerate(LINE_FEATURES)],
    )
    stats = sim.block_moments(lines, "block", [f"f{i}" for i in range(len(LINE_FEATURES))])
    cells = stats.select("block", "n", "mean", F.posexplode("cov").alias("place", "value"))
    p = len(LINE_FEATURES)
    row, column = F.floor(F.col("place") / p).cast("bigint"), (F.col("place") % p).cast("bigint")
    mean = F.get("mean", row.cast("int"))
    return cells.select(
        "block", "n", row.alias("i"), column.alias("j"), F.round(mean, 6).alias("mean"), F.round("value", 4).alias("cov")
    )


def _matches(spark, sf_dir, features=TWO):
    """Block 0 against every block of another patient."""
    stats = stage(_library_stats(spark, sf_dir, features), "library-stats")
    query = stats.where("block_id = 0")
    patient = query.select("patient_id").scalar()
    others = stats.withColumn("_p", patient).where(F.col("patient_id") != F.col("_p")).drop("_p")
    return query, sim.search(query, others)


def hotelling2(spark, sf_dir):
    return _matches(spark, sf_dir)[1].select("block_id", F.round("t2", 6).alias("t2"))


def hotelling3(spark, sf_dir):
    return _matches(spark, sf_dir, THREE)[1].select("block_id", F.round("t2", 6).alias("t2"))


def hotelling4(spark, sf_dir):
    return _matches(spark, sf_dir, FOUR)[1].select("block_id", F.round("t2", 6).alias("t2"))


def _top(spark, sf_dir, k=10):
    return sim.top_matches(_matches(spark, sf_dir)[1], k)


def knn_topk(spark, sf_dir):
    return _top(spark, sf_dir).select(
        "rank", "block_id", "patient_id", "class_label", F.round("t2", 6).alias("t2"),
        F.round("weight", 4).alias("weight"),
    )


def patient_summary(spark, sf_dir):
    rows = sim.patient_summary(_top(spark, sf_dir, 40))
    return rows.withColumn("best_t2", F.round("best_t2", 6)).withColumn(
        "weighted_score", F.round("weighted_score", 4)
    )


def class_vote(spark, sf_dir):
    rows = sim.class_votes(_top(spark, sf_dir, 40))
    return rows.withColumn("best_t2", F.round("best_t2", 6)).withColumn(
        "weight", F.round("weight", 4)
    ).withColumn("share", F.round("share", 6))


def feature_diffs(spark, sf_dir):
    query, matches = _matches(spark, sf_dir, FOUR)
    one = query.select("mean").scalar()
    pairs = matches.select("block_id", F.col("mean").alias("reference_mean")).withColumn(
        "query_mean", one
    )
    rows = sim.feature_differences(pairs, FOUR)
    return rows.select("block_id", "place", "feature", F.round("abs_diff", 3).alias("abs_diff"))


def _with_metadata(spark, sf_dir):
    library = block_library(spark, sf_dir)
    return library.select(
        "*",
        (F.col("acctbal") > 0).alias("verified"),
        F.floor(F.col("acctbal") / 1000).cast("bigint").alias("step"),
        F.concat(F.lit(" "), F.floor(F.col("acctbal") / 2000).cast("string")).alias("section"),
    )


def ref_filter(spark, sf_dir):
    kept = sim.metadata_filter(
        _with_metadata(spark, sf_dir),
        {
            "class_label": ["AFRICA", "ASIA", "EUROPE"],
            "verified": True,
            "step": [1, "2", 3.0, 6, 7],
            "section": [0, 1, "3.0"],
            "unknown": None,
        },
    )
    return kept.select("block_id")


def ref_exclude(spark, sf_dir):
    blocks = (
        block_library(spark, sf_dir)
        .join(_stats(spark, sf_dir).select("block_id", "n"), "block_id")
        .withColumn("relpath", F.concat(F.lit("lib/"), F.col("sample_identifier")))
        .withColumn("path", F.concat(F.lit("/data/lib/"), F.col("sample_identifier")))
    )
    marked = sim.mark_exclusions(
        blocks,
        patient_id=" NATION_3 ",
        reference_id="Supplier#000000007",
        query_path="/other/lib/Supplier#000000001",
    )
    return marked.select("block_id", "excluded_by")


def ref_guard(spark, sf_dir):
    """Orders as blocks: depth is the largest line number, expected to be 7."""
    items = table(spark, sf_dir, "lineitem")
    stats = items.groupBy(F.col("l_orderkey").alias("block_id")).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber"))).alias("block_depth"),
    )
    return sim.guard(stats, expected_depth=7).groupBy("status").agg(
        F.count("*").alias("blocks"), F.sum("n").alias("rows")
    )


def _loo_top(spark, sf_dir):
    stats = _library_stats(spark, sf_dir).select(
        "block_id", "patient_id", "class_label", "n", "mean", "cov"
    )
    return sim.nearest_other_patients(stats, len(TWO))


def loo_matches(spark, sf_dir):
    return _loo_top(spark, sf_dir).select(
        "query_id", "rank", "block_id", F.round("t2", 6).alias("t2")
    )


def loo_accuracy(spark, sf_dir):
    return sim.loo_accuracy(sim.leave_one_out(stage(_loo_top(spark, sf_dir), "loo")))


def loo_distances(spark, sf_dir):
    return sim.loo_distances(sim.leave_one_out(stage(_loo_top(spark, sf_dir), "loo")))


def loo_calibration(spark, sf_dir):
    return sim.loo_calibration(sim.leave_one_out(stage(_loo_top(spark, sf_dir), "loo")))


def loo_auc(spark, sf_dir):
    return sim.loo_auc(stage(_loo_top(spark, sf_dir), "loo"))


def stats_refresh(spark, sf_dir):
    """Blocks of the first ten nations changed since their statistics were stored."""
    rows = block_rows(spark, sf_dir)
    nation = F.regexp_extract("patient_id", r"(\d+)$", 1).cast("int")

    def signed(modified):
        return block_library(spark, sf_dir).select(
            "block_id",
            sim.statistics_signature(
                F.col("acctbal"), modified, "two", TWO, sim.SHRINKAGE, None
            ).alias("signature"),
        )

    stored = _stats(spark, sf_dir).join(signed(F.lit(1)), "block_id")
    current = signed(F.when(nation < 10, F.lit(2)).otherwise(F.lit(1)))
    fresh = sim.refresh_statistics(stage(stored, "stats"), current, rows, "block_id", TWO)
    return fresh.select(
        "block_id", "n", F.round(F.get("mean", F.lit(0)), 6).alias("mean_0"),
        F.round(F.get("cov", F.lit(3)), 6).alias("cov_11"), "rebuilt",
    )


QUERIES = {
    f.__name__: f
    for f in (
        block_stats, block_moments, hotelling2, hotelling3, hotelling4, knn_topk, patient_summary, class_vote, feature_diffs,
        ref_filter, ref_exclude, ref_guard, loo_matches, loo_accuracy, loo_distances,
        loo_calibration, loo_auc, stats_refresh,
    )
}

STATS = """raw AS (SELECT l_suppkey AS block_id, count(*) AS n, avg(l_quantity) AS m0,
    avg(l_discount) AS m1, covar_samp(l_quantity, l_quantity) AS v0,
    covar_samp(l_quantity, l_discount) AS v01, covar_samp(l_discount, l_discount) AS v1
  FROM lineitem GROUP BY l_suppkey),
  stats AS (SELECT block_id, n, m0, m1, 0.95::DOUBLE * v0 + 0.05::DOUBLE * (v0 + v1) / 2 AS a,
    0.95::DOUBLE * v01 AS b, 0.95::DOUBLE * v1 + 0.05::DOUBLE * (v0 + v1) / 2 AS d FROM raw)"""


def _t2_sql(q: str, r: str) -> str:
    freedom = f"({q}.n + {r}.n - 2)"
    a, b, d = (
        f"((({q}.n - 1) * {q}.{c} + ({r}.n - 1) * {r}.{c}) / {freedom})" for c in "abd"
    )
    x, y = f"({q}.m0 - {r}.m0)", f"({q}.m1 - {r}.m1)"
    return (
        f"({q}.n * {r}.n / ({q}.n + {r}.n)) * ({d} * {x} * {x} - 2 * {b} * {x} * {y} "
        f"+ {a} * {y} * {y}) / ({a} * {d} - {b} * {b})"
    )


def _hotelling3_sql() -> str:
    """Distance over three features by the adjugate of the pooled matrix."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    raw = ", ".join(
        [f"avg({c}) AS m{i}" for i, c in enumerate(columns)]
        + [f"covar_samp({columns[i]}, {columns[j]}) AS r{i}{j}" for i, j in cells]
    )
    shrunk = ", ".join(
        f"0.95::DOUBLE * r{i}{j}" + (" + 0.05::DOUBLE * (r00 + r11 + r22) / 3" if i == j else "") + f" AS s{i}{j}"
        for i, j in cells
    )
    pooled = ", ".join(
        f"((q.n - 1) * q.s{i}{j} + (r.n - 1) * r.s{i}{j}) / (q.n + r.n - 2) AS p{i}{j}" for i, j in cells
    )
    delta = ", ".join(f"q.m{i} - r.m{i} AS d{i}" for i in range(3))

    def minor(i: int, j: int) -> str:
        rows, cols = [a for a in range(3) if a != i], [a for a in range(3) if a != j]
        cell = [[f"p{min(a, b)}{max(a, b)}" for b in cols] for a in rows]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}({cell[0][0]} * {cell[1][1]} - {cell[0][1]} * {cell[1][0]})"

    form = " + ".join(f"d{i} * d{j} * ({minor(i, j)})" for i in range(3) for j in range(3))
    det = " + ".join(f"p0{j} * ({minor(0, j)})" for j in range(3))
    return f"""WITH {LIBRARY}, raw AS (SELECT l_suppkey AS block_id, count(*) AS n, {raw} FROM lineitem GROUP BY ALL),
      s3 AS (SELECT raw.*, patient_id, {shrunk} FROM raw JOIN library USING (block_id) WHERE n >= 5),
      p AS (SELECT r.block_id, q.n * r.n / (q.n + r.n) AS k, {delta}, {pooled} FROM s3 q JOIN s3 r
        ON q.block_id = 0 AND q.patient_id <> r.patient_id)
      SELECT block_id, round(k * ({form}) / ({det}), 6) AS t2 FROM p"""


def _hotelling_sql(columns: list[str]) -> str:
    """Distance over any number of features, by eliminating one feature of the pooled matrix after
    another: each step adds its squared difference over its pivot."""
    p = len(columns)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    raw = ", ".join(
        [f"avg({c}) AS m{i}" for i, c in enumerate(columns)]
        + [f"covar_samp({columns[i]}, {columns[j]}) AS r{i}{j}" for i, j in cells]
    )
    trace = " + ".join(f"r{i}{i}" for i in range(p))
    shrunk = ", ".join(
        f"0.95::DOUBLE * r{i}{j}" + (f" + 0.05::DOUBLE * ({trace}) / {p}" if i == j else "") + f" AS s{i}{j}"
        for i, j in cells
    )
    pooled = ", ".join(
        f"((q.n - 1) * q.s{i}{j} + (r.n - 1) * r.s{i}{j}) / (q.n + r.n - 2) AS p{i}{j}" for i, j in cells
    )
    delta = ", ".join(f"q.m{i} - r.m{i} AS d{i}" for i in range(p))
    steps = [
        f"""e0 AS (SELECT r.block_id, q.n * r.n / (q.n + r.n) AS k, 0::DOUBLE AS form, {delta}, {pooled}
        FROM shrunk q JOIN shrunk r ON q.block_id = 0 AND q.patient_id <> r.patient_id)"""
    ]
    for k in range(p):
        left = [
            "block_id", "k", f"form + d{k} * d{k} / p{k}{k} AS form",
            *[f"d{i} - p{k}{i} / p{k}{k} * d{k} AS d{i}" for i in range(k + 1, p)],
            *[f"p{i}{j} - p{k}{i} * p{k}{j} / p{k}{k} AS p{i}{j}" for i, j in cells if i > k],
        ]
        steps.append(f"e{k + 1} AS (SELECT {', '.join(left)} FROM e{k})")
    return f"""WITH {LIBRARY}, raw AS (SELECT l_suppkey AS block_id, count(*) AS n, {raw} FROM lineitem GROUP BY ALL),
      shrunk AS (SELECT raw.*, patient_id, {shrunk} FROM raw JOIN library USING (block_id) WHERE n >= 5),
      {", ".join(steps)} SELECT block_id, round(k * form, 6) AS t2 FROM e{p}"""


PAIRS = f"""{STATS}, {LIBRARY}, full_stats AS (SELECT * FROM stats JOIN library USING (block_id) WHERE n >= 5),
  pairs AS (SELECT q.block_id AS query_id, q.class_label AS query_class, r.block_id, r.patient_id,
      r.class_label, {_t2_sql("q", "r")} AS t2
    FROM full_stats q JOIN full_stats r ON q.patient_id <> r.patient_id)"""
ONE = f"{PAIRS}, matches AS (SELECT * FROM pairs WHERE query_id = 0)"


def _top_sql(k: int, source: str = "matches", part: str = "") -> str:
    return f"""top AS (SELECT *, row_number() OVER ({part} ORDER BY t2, patient_id, block_id) AS rank,
      1 / (t2 + 1e-12::DOUBLE) AS weight FROM {source} QUALIFY rank <= {k})"""


LOO = f"""{PAIRS}, {_top_sql(5, "pairs", "PARTITION BY query_id")},
  votes AS (SELECT query_id, class_label, count(*) AS n, sum(weight) AS w, min(t2) AS best
    FROM top GROUP BY ALL),
  shares AS (SELECT *, round(w / sum(w) OVER (PARTITION BY query_id), 8) AS share FROM votes),
  truth AS (SELECT query_id, query_class, min(t2) AS best_t2 FROM top GROUP BY ALL),
  preds AS (SELECT query_id, class_label AS predicted_class, share AS confidence FROM shares
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, n DESC, best, class_label) = 1),
  loo AS (SELECT *, predicted_class = query_class AS correct FROM preds JOIN truth USING (query_id))"""

_P = len(LINE_FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(_P)]
_COVARIANCES = ", ".join(f"covar_samp(f{i}, f{j})" for i, j in _PAIRS)
MOMENTS = f"""x AS (SELECT (l_suppkey % 64)::BIGINT AS block,
    {", ".join(f"({f})::DOUBLE AS f{i}" for i, f in enumerate(LINE_FEATURES))} FROM lineitem),
  s AS (SELECT block, count(*) AS n, [{", ".join(f"avg(f{i})" for i in range(_P))}] AS m, [{_COVARIANCES}] AS c
    FROM x GROUP BY block),
  t AS (SELECT *, list_sum(list_transform(range({_P}), lambda i: c[i * {_P + 1} + 1])) / {_P} AS variance FROM s)"""

ORACLES = {
    "block_moments": f"""WITH {MOMENTS}, e AS (SELECT block, n, m, c, variance, unnest(range({_P * _P})) AS place FROM t)
      SELECT block, n, place // {_P} AS i, place % {_P} AS j, round(m[place // {_P} + 1], 6) AS mean,
        round(0.95::DOUBLE * c[place + 1] + CASE WHEN place // {_P} = place % {_P} THEN 0.05::DOUBLE * variance ELSE 0 END, 4) AS cov
      FROM e""",
    "block_stats": f"""WITH {STATS} SELECT block_id, n, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1,
      round(a, 5) AS cov_00, round(b, 6) AS cov_01, round(b, 6) AS cov_10, round(d, 6) AS cov_11 FROM stats""",
    "hotelling2": f"WITH {ONE} SELECT block_id, round(t2, 6) AS t2 FROM matches",
    "hotelling3": _hotelling3_sql(),
    "hotelling4": _hotelling_sql(["l_quantity", "l_discount", "l_tax", "l_extendedprice"]),
    "knn_topk": f"""WITH {ONE}, {_top_sql(10)} SELECT rank, block_id, patient_id, class_label,
      round(t2, 6) AS t2, round(weight, 4) AS weight FROM top""",
    "patient_summary": f"""WITH {ONE}, {_top_sql(40)},
      c AS (SELECT patient_id, class_label, count(*) AS n FROM top GROUP BY ALL),
      cs AS (SELECT patient_id, string_agg(class_label || ':' || n, ',' ORDER BY n DESC, class_label)
        AS class_counts FROM c GROUP BY patient_id),
      s AS (SELECT patient_id, count(*) AS match_count, round(sum(weight), 8) AS w, min(t2) AS t,
        arg_min(block_id, rank) AS best_block FROM top GROUP BY patient_id)
      SELECT patient_id, match_count, round(w, 4) AS weighted_score, round(t, 6) AS best_t2, best_block,
        class_counts, row_number() OVER (ORDER BY w DESC, t, patient_id) AS position
      FROM s JOIN cs USING (patient_id)""",
    "class_vote": f"""WITH {ONE}, {_top_sql(40)},
      v AS (SELECT class_label, count(*) AS count, sum(weight) AS w, min(t2) AS t FROM top GROUP BY ALL)
      SELECT class_label, count, round(w, 4) AS weight, round(t, 6) AS best_t2,
        round(w / sum(w) OVER (), 6) AS share,
        row_number() OVER (ORDER BY w DESC, count DESC, t, class_label) AS position FROM v""",
    "feature_diffs": f"""WITH {LIBRARY}, m AS (SELECT l_suppkey AS block_id, avg(l_quantity) AS quantity,
        avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_extendedprice) AS price
        FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5),
      q AS (SELECT m.*, patient_id FROM m JOIN library USING (block_id) WHERE block_id = 0),
      u AS (SELECT m.block_id, unnest(['quantity', 'discount', 'tax', 'price']) AS feature,
          unnest([abs(q.quantity - m.quantity), abs(q.discount - m.discount), abs(q.tax - m.tax),
            abs(q.price - m.price)]) AS diff
        FROM m JOIN library USING (block_id), q WHERE library.patient_id <> q.patient_id),
      ranked AS (SELECT block_id, row_number() OVER (PARTITION BY block_id
        ORDER BY round_even(diff, 4) DESC, feature) AS place, feature, round(round_even(diff, 4), 3) AS abs_diff FROM u)
      SELECT * FROM ranked WHERE place <= 3""",
    "ref_filter": f"""WITH {LIBRARY} SELECT block_id FROM library
      WHERE class_label IN ('AFRICA', 'ASIA', 'EUROPE') AND acctbal > 0
        AND floor(acctbal / 1000) IN (1, 2, 3, 6, 7) AND floor(acctbal / 2000) IN (0, 1, 3)""",
    "ref_exclude": f"""WITH {LIBRARY} SELECT block_id, CASE WHEN patient_id = 'NATION_3' THEN 'patient'
        WHEN n < 5 THEN 'too_few_rows' WHEN block_id = 7 THEN 'reference_id'
        WHEN block_id = 1 THEN 'self_match' END AS excluded_by
      FROM library JOIN (SELECT l_suppkey AS block_id, count(*) AS n FROM lineitem GROUP BY ALL)
      USING (block_id)""",
    "ref_guard": """WITH s AS (SELECT l_orderkey, count(*) AS n,
        max(l_linenumber) FILTER (l_linenumber > 2) AS depth FROM lineitem GROUP BY l_orderkey)
      SELECT CASE WHEN depth <> 7 THEN 'depth_mismatch' WHEN n < 5 THEN 'too_few_rows' ELSE 'ok' END AS status,
        count(*) AS blocks, sum(n)::BIGINT AS rows FROM s GROUP BY status""",
    "loo_matches": f"""WITH {LOO} SELECT query_id, rank, block_id, round(t2, 6) AS t2 FROM top""",
    "loo_accuracy": f"""WITH {LOO} SELECT query_class, count(*) AS queries, count(*) FILTER (correct) AS correct,
      round(avg(correct::INTEGER), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence
      FROM loo GROUP BY query_class""",
    "loo_distances": f"""WITH {LOO} SELECT correct, count(*) AS queries, round(avg(best_t2), 6) AS mean_best_t2,
      round(min(best_t2), 6) AS min_best_t2, round(max(best_t2), 6) AS max_best_t2 FROM loo GROUP BY correct""",
    "loo_calibration": f"""WITH {LOO} SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS queries,
      round(avg(confidence), 6) AS mean_confidence, round(avg(correct::INTEGER), 6) AS accuracy
      FROM loo GROUP BY bin""",
    "loo_auc": f"""WITH {LOO}, classes AS (SELECT DISTINCT query_class AS class_label FROM truth),
      s AS (SELECT c.class_label, query_id, query_class = c.class_label AS pos, coalesce(share, 0) AS score
        FROM (SELECT * FROM truth, classes) c LEFT JOIN shares USING (query_id, class_label)),
      r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY class_label, score) - 1) / 2 AS rk
        FROM s WINDOW w AS (PARTITION BY class_label ORDER BY score))
      SELECT class_label, count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos) AS negatives,
        round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2)
          / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc FROM r GROUP BY class_label""",
    "stats_refresh": f"""WITH {STATS}, {LIBRARY} SELECT block_id, n, round(m0, 6) AS mean_0,
      round(d, 6) AS cov_11, regexp_extract(patient_id, '([0-9]+)$', 1)::INTEGER < 10 AS rebuilt
      FROM stats JOIN library USING (block_id)""",
}
