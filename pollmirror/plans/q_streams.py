"""Streaming queries, drained over the tables with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import common as C
from ..streaming import intake as I
from ..streaming import limits as L
from .q_quality import DOC_SQL
from .registry import query


def event_stream(s):
    d = C.table_stream(s.spark, s.sf_dir, "events")
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@query("s_access_counts", """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d, event_type FROM events) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY d, event_type""")
def s_access_counts(s):
    out, ck = C.shared_folder(s.spark, "access"), C.shared_folder(s.spark, "access-ck")
    C.drain(L.access_counts(event_stream(s), ["event_type"]), out, ck)
    d = s.spark.read.schema("start timestamp, event_type string, n long").parquet(out)
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


LIMIT, SECONDS = 2, 43_200


# ordered replay: one row of every key per step, with the accepted times that are still in its window
REPLAY_SQL = f"""SELECT api_key, count(*) AS n, count(*) FILTER (ok) AS n_allowed FROM (
    WITH RECURSIVE ev AS (SELECT user_id AS api_key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    run AS (SELECT api_key, rn, true AS ok, [t] AS held FROM ev WHERE rn = 1
      UNION ALL SELECT e.api_key, e.rn, len(list_filter(r.held, lambda h: h >= e.t - {SECONDS * 1_000_000})) < {LIMIT} AS ok,
        CASE WHEN len(list_filter(r.held, lambda h: h >= e.t - {SECONDS * 1_000_000})) < {LIMIT} THEN list_append(list_filter(r.held, lambda h: h >= e.t - {SECONDS * 1_000_000}), e.t)
          ELSE list_filter(r.held, lambda h: h >= e.t - {SECONDS * 1_000_000}) END AS held
        FROM run r JOIN ev e ON e.api_key = r.api_key AND e.rn = r.rn + 1)
    SELECT api_key, ok FROM run) GROUP BY api_key"""


def submissions(s):
    return event_stream(s).select(F.col("event_id").alias("id"), F.col("user_id").alias("api_key"), F.col("ts").alias("submitted_at"))


@query("s_rate_limit", REPLAY_SQL)
def s_rate_limit(s):
    out, ck = C.shared_folder(s.spark, "limit"), C.shared_folder(s.spark, "limit-ck")
    C.drain(L.rate_limit(submissions(s), LIMIT, SECONDS), out, ck, conf=L.STORE)
    r = s.spark.read.schema(L.DECIDED).parquet(out)
    return r.groupBy("api_key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("s_busy_windows", f"""SELECT api_key, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) > {LIMIT} AS over FROM (
    SELECT user_id AS api_key, time_bucket(INTERVAL {SECONDS // 4} SECONDS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL {SECONDS // 4} SECONDS AS start FROM events, range(0, 4) r(k))
    WHERE start + INTERVAL {SECONDS} SECONDS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY api_key, start""")
def s_busy_windows(s):
    out, ck = C.shared_folder(s.spark, "busy"), C.shared_folder(s.spark, "busy-ck")
    C.drain(L.busy_windows(submissions(s), LIMIT, SECONDS, SECONDS // 4), out, ck)
    d = s.spark.read.schema("api_key long, start timestamp, n long, over boolean").parquet(out)
    return d.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("s_rate_limit_batch", f"SELECT event_id AS id, user_id AS api_key, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {SECONDS} SECONDS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS recent FROM events")
def s_rate_limit_batch(s):
    d = s.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("api_key"), F.col("ts").alias("submitted_at"))
    return L.trailing_counts(d, SECONDS).select("id", "api_key", "recent")


@query("s_intake", """SELECT run_id, CASE WHEN reason IS NULL THEN 'validating' ELSE 'rejected' END AS status, reason FROM (SELECT run_id, CASE
    WHEN NOT json_valid(raw) OR json_type(raw::JSON) <> 'OBJECT' THEN 'body is not a JSON object' WHEN (raw::JSON ->> '$.benchmark') <> 'survey' THEN 'wrong benchmark marker'
    WHEN json_type(raw::JSON, '$.config') <> 'OBJECT' THEN 'missing or invalid config' END AS reason FROM rawdocs)""", ctes="parts", rawdocs=DOC_SQL)
def s_intake(s):
    from .bridge import Survey
    from .q_quality import documents

    class Streamed(Survey):
        def table(self, name):
            return C.table_stream(self.spark, self.sf_dir, name)

    out, ck = C.shared_folder(s.spark, "intake"), C.shared_folder(s.spark, "intake-ck")
    I.run_intake(documents(Streamed(s.spark, s.sf_dir)), "survey", out, ck)
    schema = "run_id string, reason string, status string, model_name string, dataset string, n_questions long"
    parts = [s.spark.read.schema(schema).parquet(f"{out}/{n}") for n in ("accepted", "rejected")]
    return parts[0].unionByName(parts[1]).select("run_id", "status", "reason")
