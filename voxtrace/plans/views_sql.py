"""SQL text of the views in ``voxtrace.sources.tables`` for the DuckDB side of the check."""

DENSE = """cells AS (
  SELECT l_suppkey // 50 AS volume_id, (month(l_shipdate) - 1)::BIGINT AS z,
         (day(l_shipdate) - 1)::BIGINT AS y, (l_linenumber - 1)::BIGINT AS x,
         round(sum(l_quantity) / count(*)) AS v
  FROM lineitem GROUP BY ALL),
dense AS (
  SELECT volume_id, g.z, g.y, g.x, coalesce(v, 0)::DOUBLE AS v
  FROM (SELECT DISTINCT volume_id, a.z, b.y, c.x FROM cells,
        range(0, 12) a(z), range(0, 31) b(y), range(0, 7) c(x)) g
  LEFT JOIN cells USING (volume_id, z, y, x))"""

SPARSE = """sparse AS (
  SELECT user_id // 40 AS volume_id, hour(ts)::BIGINT AS z, (day(ts) - 1)::BIGINT AS y,
         user_id % 40 AS x,
         max(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)::BIGINT AS label,
         sum(value) / count(*) AS v
  FROM events GROUP BY ALL)"""

MASKS = """masks AS (
  SELECT l_suppkey AS pair, l_orderkey AS row_id, l_linenumber AS col_id,
         max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END)::BIGINT AS pred,
         max(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END)::BIGINT AS gt
  FROM lineitem GROUP BY ALL)"""

MISSING = """missing AS (
  SELECT * REPLACE (CASE WHEN l_linenumber <> 7 THEN l_tax END AS l_tax,
                    CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS l_linestatus)
  FROM lineitem)"""

LIBRARY = """library AS (
  SELECT s_suppkey AS block_id, s_name AS sample_identifier, n_name AS patient_id,
         r_name AS class_label, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

TRACE = """trace AS (
  SELECT user_id AS run_id, event_id, ts, event_type AS route,
         event_type <> 'error' AS success, props AS args, value
  FROM events)"""

RUNS = """runs AS (
  SELECT o_custkey AS task_id, o_orderkey AS run_id, o_orderdate AS batch_time,
         CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'error' END AS status,
         o_totalprice AS price
  FROM orders)"""
