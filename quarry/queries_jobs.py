"""Queries of jobs as a stateful stream over the event log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.stages import new_path
from quarry.streaming import jobs

from .queries import query, table

OPS = ("submit", "start", "rows", "status", "rows", "results", "cancel", "fail", "rows", "erase", "rows")


def answered(spark, sf_dir) -> DataFrame:
    """Users are jobs, their events requests: what is asked follows from the event's number."""
    k = F.col("event_id")
    schema = table(spark, sf_dir, "events").schema
    log = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream reads a folder or a pattern, not one file
    op = F.array(*[F.lit(x) for x in OPS])[F.pmod(k, F.lit(len(OPS))).cast("int")]
    asked = log.select(F.col("user_id").cast("string").alias("job"), k.cast("long").alias("seq"), op.alias("op"), (1 + F.pmod(k, F.lit(4))).cast("long").alias("n"))
    target = new_path(spark, "answers")
    jobs.serve(asked, target, new_path(spark, "answers-checkpoint")).awaitTermination()
    return spark.read.schema(jobs.ANSWERS).parquet(target)


ANSWERED = """WITH RECURSIVE asked AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, (['submit', 'start', 'rows', 'status', 'rows', 'results', 'cancel', 'fail', 'rows', 'erase', 'rows'])[event_id % 11 + 1] AS op, 1 + event_id % 4 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
told AS (SELECT job, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS answer, NULL::VARCHAR AS state, NULL::BIGINT AS done, NULL::BIGINT AS total FROM (SELECT DISTINCT job FROM asked) UNION ALL
SELECT t.job, a.r, a.seq, a.op,
  CASE WHEN a.op = 'erase' THEN 'bad_request' WHEN t.state IS NULL THEN CASE WHEN a.op = 'submit' THEN 'ok' ELSE 'not_found' END WHEN a.op = 'status' OR (a.op = 'submit' AND t.state = 'cancelled') OR (a.op = 'start' AND t.state = 'queued') OR (a.op = 'rows' AND t.state = 'running') OR (a.op IN ('fail', 'cancel') AND t.state IN ('queued', 'running'))
    OR (a.op = 'results' AND t.state IN ('completed', 'cancelled', 'failed')) THEN 'ok' ELSE 'conflict' END,
  CASE WHEN a.op = 'submit' AND (t.state IS NULL OR t.state = 'cancelled') THEN 'queued' WHEN a.op = 'start' AND t.state = 'queued' THEN 'running' WHEN a.op = 'rows' AND t.state = 'running' AND t.done + a.n >= t.total THEN 'completed' WHEN a.op = 'fail' AND t.state IN ('queued', 'running') THEN 'failed' WHEN a.op = 'cancel' AND t.state IN ('queued', 'running') THEN 'cancelled' ELSE t.state END,
  CASE WHEN t.state IS NULL THEN CASE WHEN a.op = 'submit' THEN 0 END WHEN a.op = 'rows' AND t.state = 'running' THEN least(t.done + a.n, t.total) ELSE t.done END,
  CASE WHEN t.state IS NULL THEN CASE WHEN a.op = 'submit' THEN a.n END ELSE t.total END
FROM told t JOIN asked a ON a.job = t.job AND a.r = t.r + 1)
"""


@query(ANSWERED + "SELECT job, seq, op, answer, state, done, total FROM told WHERE r > 0")
def job_answers(spark, sf_dir):
    return answered(spark, sf_dir)


@query(ANSWERED + "SELECT job, state, done, total FROM told WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY r DESC) = 1")
def job_states(spark, sf_dir):
    return jobs.latest(answered(spark, sf_dir))
