"""Live-progress bindings (ST1-ST7): ``events`` as the progress stream.

job = ``user_id``, kind = ``event_type``, count = ``floor(value)``, seq =
``event_id``. The batch twins are oracle-checked; the ``*_stream`` queries run
the real Structured Streaming folds (``availableNow``) and share the twins' SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.plans.catalog import query
from routelens.sources.tables import table
from routelens.streaming import progress as P

SQL_PROG = """(SELECT user_id AS job_id, event_id AS seq, event_type AS kind, 'f' || CAST(event_id % 7 AS VARCHAR) AS file,
   CAST(floor(value) AS BIGINT) AS count FROM events)"""
SQL_STATUS = ("CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.KIND_STATUS.items()) + " END")
SQL_STATE = f"""(SELECT job_id, arg_max({SQL_STATUS}, seq) AS status,
   arg_max(file, seq) FILTER (WHERE kind = 'error') AS last_error,
   arg_max(count, seq) FILTER (WHERE kind = 'signup') AS routes_total,
   count(*) FILTER (WHERE kind = 'click') AS routes_done, count(*) FILTER (WHERE kind = 'error') AS routes_failed,
   sum(CASE WHEN kind = 'purchase' THEN count ELSE 0 END) AS endpoints, count(*) FILTER (WHERE kind = 'purchase') AS schemas_resolved,
   count(*) AS n_events, max(seq) AS last_seq FROM {SQL_PROG} GROUP BY job_id)"""


def progress(spark, sf_dir):
    return P.as_progress(table(spark, sf_dir, "events"))


@query("job_status", sql=f"SELECT job_id, status, last_error, last_seq FROM {SQL_STATE}")
def q_job_status(spark, sf_dir):
    """ST1: last status and error per job (order by seq, arrival order irrelevant)."""
    return P.job_state(progress(spark, sf_dir)).select("job_id", "status", "last_error", "last_seq")


@query("job_progress", sql=f"SELECT job_id, routes_total, routes_done, routes_failed, endpoints FROM {SQL_STATE}")
def q_job_progress(spark, sf_dir):
    """ST2: running counters per job."""
    return P.job_state(progress(spark, sf_dir)).select("job_id", "routes_total", "routes_done", "routes_failed", "endpoints")


@query("schema_event_fold", sql=f"""SELECT job_id, count(*) FILTER (WHERE kind = 'purchase') AS resolved,
  count(*) FILTER (WHERE kind = 'error') AS unresolved, count(DISTINCT file) FILTER (WHERE kind IN ('purchase', 'error')) AS n_names
  FROM {SQL_PROG} GROUP BY job_id""")
def q_schema_event_fold(spark, sf_dir):
    """ST6: resolved / unresolved counters and distinct names per job."""
    p = progress(spark, sf_dir)
    return p.groupBy("job_id").agg(F.count_if(F.col("kind") == "purchase").alias("resolved"),
                                   F.count_if(F.col("kind") == "error").alias("unresolved"),
                                   F.count_distinct(F.when(F.col("kind").isin("purchase", "error"), F.col("file"))).alias("n_names"))


SQL_TAIL = f"""
WITH n AS (SELECT job_id, count(*) AS n_log FROM {SQL_PROG} GROUP BY 1),
r AS (SELECT p.job_id, p.seq, n.n_log, row_number() OVER (PARTITION BY p.job_id ORDER BY p.seq DESC) AS rk FROM {SQL_PROG} p JOIN n USING (job_id))
SELECT job_id, n_log, count(*) AS tail_len, min(seq) AS first_kept_seq FROM r
WHERE rk <= CASE WHEN n_log <= 100 THEN n_log ELSE 80 + ((n_log - 101) % 21) END GROUP BY 1, 2"""


@query("job_log_tail", sql=SQL_TAIL)
def q_job_log_tail(spark, sf_dir):
    """ST3: the capped log (append; past 100 entries keep the last 80)."""
    return P.log_tail(progress(spark, sf_dir))


@query("phase_status", sql=f"""SELECT job_id, kind AS phase, arg_max(CASE WHEN seq % 2 = 1 THEN 'active' ELSE 'complete' END, seq) AS status,
  count(*) AS n FROM {SQL_PROG} GROUP BY 1, 2""")
def q_phase_status(spark, sf_dir):
    """ST4: latest status per (job, phase)."""
    return P.phase_status(progress(spark, sf_dir))


@query("in_flight", sql=f"""SELECT job_id, file, sum(CASE WHEN kind IN ('view', 'click') THEN 1 WHEN kind IN ('purchase', 'error') THEN -1 ELSE 0 END) AS open
  FROM {SQL_PROG} GROUP BY 1, 2 HAVING open > 0""")
def q_in_flight(spark, sf_dir):
    """ST5: files started and not finished, per job."""
    return P.in_flight(progress(spark, sf_dir))


@query("job_snapshot", sql=f"""
WITH polls AS (SELECT DISTINCT c_custkey % 200 AS job_id FROM customer), s AS {SQL_STATE}
SELECT p.job_id, CASE WHEN s.status IS NULL THEN 404 WHEN s.status = 'done' THEN 200 ELSE 409 END AS http_status,
       CASE WHEN s.status = 'done' THEN s.endpoints END AS endpoints FROM polls p LEFT JOIN s USING (job_id)""")
def q_job_snapshot(spark, sf_dir):
    """ST7: poll answers (200 with results when done, 409 while running, 404 unknown)."""
    polls = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("job_id")).distinct()
    return P.job_snapshot(P.job_state(progress(spark, sf_dir)), polls)


@query("job_state_stream", sql=f"SELECT * FROM {SQL_STATE}")
def q_job_state_stream(spark, sf_dir):
    """ST1/ST2/ST6: the job fold run as a Structured Streaming query (availableNow) into a snapshot table."""
    return P.run_job_state_stream(spark, sf_dir)


@query("job_log_tail_stream", sql=SQL_TAIL)
def q_job_log_tail_stream(spark, sf_dir):
    """ST3: the log tail as a stream of partial tails per micro-batch."""
    return P.run_log_tail_stream(spark, sf_dir)


@query("job_state_stream_evicting", sql=f"SELECT * FROM {SQL_STATE}")
def q_job_state_stream_evicting(spark, sf_dir):
    """ST1/ST2/ST6: the job fold as a stream of partial folds that holds no state between micro-batches."""
    return P.run_job_state_stream_evicting(spark, sf_dir)
