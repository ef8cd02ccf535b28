"""Queries that drain a table as a stream, with the SQL of the same in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import LATIN
from ..streaming import streams as S
from .views import AS_OF, Views, duck


def items(v: Views):
    rows = S.table_stream(v.spark, v.sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("batch_id"), F.concat(F.lit("file-"), (F.col("l_orderkey") % 400).cast("string")).alias("filename"), F.col("l_linenumber").alias("item_no"),
        F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped").alias("status"), F.col("l_shipdate").alias("ts"),
    )


def tasks(v: Views):
    """Orders as tasks, each begun on its day."""
    rows = S.table_stream(v.spark, v.sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failed").otherwise("processing").alias("status"), (F.col("o_orderkey") % 4).alias("requeues"), F.col("o_orderdate").alias("ts"))


QUERIES = {
    "s2_stream_analyze": lambda v: S.stream_analyze(S.table_stream(v.spark, v.sf_dir, "documents"), LATIN),
    "s3_stream_progress": lambda v: S.collected(S.stream_progress(items(v)), "complete"),
    "s4_limit_fixed": lambda v: S.collected(S.limit_fixed(S.table_stream(v.spark, v.sf_dir, "events"), "user_id", 3, 86_400)),
    "s5_limit_sliding": lambda v: S.collected(S.limit_sliding(S.table_stream(v.spark, v.sf_dir, "events"), "user_id", 3, 86_400)),
    "s6_recover_stream": lambda v: S.collected(S.recover_stream(tasks(v), late="0 seconds")),
    "s7_stream_daily_volume": lambda v: S.collected(S.stream_daily_volume(S.table_stream(v.spark, v.sf_dir, "events")), "complete").withColumn("day", F.col("day").cast("string")),
    "s7_final_days": lambda v: S.collected(S.stream_daily_volume(S.table_stream(v.spark, v.sf_dir, "events"))).withColumn("day", F.col("day").cast("string")),
    "s8_stream_dedupe": lambda v: S.collected(S.stream_dedupe(items(v), "3650 days")).select("batch_id", "filename"),
    "s8_reused_flags": lambda v: S.reused_flags(v.v_batch_item).groupBy("batch_id").agg(F.count("*").alias("items"), F.count_if("reused").alias("reused")),
    "s9_maintenance_tick": lambda v: S.maintenance_tick(v.v_record, AS_OF),
}

# a key's events one by one, in order of time and number
_ORDERED = "e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch(CAST(ts AS TIMESTAMP)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"

SQL = {
    "s4_limit_fixed": f"""WITH RECURSIVE {_ORDERED},
    w AS (SELECT key, event_id, i, sec AS began, 1 AS n FROM e WHERE i = 1 UNION ALL
      SELECT e.key, e.event_id, e.i, CASE WHEN e.sec - began >= 86400 THEN e.sec ELSE began END, CASE WHEN e.sec - began >= 86400 THEN 1 ELSE n + 1 END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
    SELECT key, event_id, n <= 3 AS allowed FROM w""",
    "s5_limit_sliding": f"""WITH RECURSIVE {_ORDERED},
    w AS (SELECT key, event_id, i, [sec] AS held, true AS allowed FROM e WHERE i = 1 UNION ALL
      SELECT key, event_id, i, CASE WHEN len(recent) < 3 THEN list_append(recent, sec) ELSE recent END, len(recent) < 3
      FROM (SELECT e.key, e.event_id, e.i, e.sec, list_filter(held, lambda x: e.sec - x < 86400) AS recent FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1))
    SELECT key, event_id, allowed FROM w""",
    "s6_recover_stream": "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 4 >= 2 THEN 'fail' ELSE 'requeue' END AS action FROM orders WHERE o_orderstatus NOT IN ('O', 'F') AND o_orderdate < (SELECT max(o_orderdate) FROM orders)",
    "s3_stream_progress": duck(
        """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS processed,
        CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN CASE WHEN count(*) FILTER (status = 'success') > 0 THEN 'partial_success' ELSE 'failed' END ELSE 'success' END AS status, 100 AS percent FROM v_batch_item GROUP BY 1"""
    ),
    "s7_stream_daily_volume": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1",
    "s7_final_days": "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, max(ts) OVER () - INTERVAL 2 DAY AS mark FROM events) WHERE day + INTERVAL 1 DAY <= mark GROUP BY 1",
    "s8_stream_dedupe": duck("SELECT DISTINCT batch_id, filename FROM v_batch_item WHERE status = 'success'"),
    "s8_reused_flags": duck(
        "SELECT batch_id, count(*) AS items, count(*) FILTER (coalesce(earliest < here, false)) AS reused FROM (SELECT batch_id, row(ts, item_no) AS here, min(CASE WHEN status = 'success' THEN row(ts, item_no) END) OVER (PARTITION BY batch_id, filename ORDER BY ts, item_no RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS earliest FROM v_batch_item) GROUP BY 1"
    ),
    "s9_maintenance_tick": duck(
        f"""SELECT * FROM (SELECT record_id, 'repair' AS action FROM v_record WHERE status = 'success' AND target_source = 'detected' AND job_profile_id IS NULL ORDER BY record_id DESC LIMIT 50)
        UNION ALL SELECT * FROM (SELECT record_id, CASE WHEN record_id % 4 >= 2 THEN 'fail' ELSE 'requeue' END FROM v_record WHERE status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 75 SECOND ORDER BY created_at, record_id LIMIT 50)"""
    ),
}
