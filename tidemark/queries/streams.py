"""Streaming queries, run to the end of what is there, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import inject as I

from tidemark.queries import base as B
from tidemark.queries.decisions import _choose, FUZZY_CANDIDATES
from tidemark.queries.registry import query
from tidemark.queries.repair import SQL_FILLED, SQL_MAP, WS, _lenient
from tidemark.session import scratch_path
from tidemark.streaming import streams as T

_SINGLE = B.PEOPLE + ",\n" + B.sql_dirty("hard", duplicates=False)
_OPEN = f"found AS (SELECT *, {B.sql_list(*B.PEOPLE_ISSUES, *B.OUTLIER_ISSUES)} AS issues FROM dirty)"
_CLEAN = f"""{_SINGLE}, {B.ISSUES}, ff AS (SELECT {SQL_FILLED}, array_to_string(issues, ',') AS issues FROM found)
  SELECT row_id, name, issues, CASE WHEN {B._outside('age', 'age')} THEN 35 ELSE age END AS age, CASE WHEN salary > 200000 OR salary < 0 THEN 70000 ELSE salary END AS salary,
    CASE WHEN {B._outside(_lenient, 'score')} THEN 80.0 ELSE {_lenient} END::DOUBLE AS score, {SQL_MAP.format(c='dept')} AS dept, trim(lower(email), {WS}) AS email FROM ff"""
_CLEAN_COLS = ["row_id", "name", "issues", "age", "salary", "score", "dept", "email"]


def _dirty_single(people):
    d = I.inject_missing(people, 0.3)
    d = I.inject_outliers(d, 0.1)
    d = I.inject_category_errors(d, 0.2)
    d = I.inject_type_errors(d, 0.05)
    return I.inject_formatting_errors(d, 0.1)


@query("stream_clean", f"WITH {_CLEAN}")
def stream_clean(spark, sf):
    s = T.stream_clean(_dirty_single(B.people_of(T.stream_table(spark, sf, "customer"))), "hard")
    out = T.run_available(s, scratch_path(spark, "clean"), scratch_path(spark, "state"))
    return out.withColumn("issues", F.array_join("issues", ",")).select(_CLEAN_COLS)


_DECIDE = f"""{_SINGLE}, {FUZZY_CANDIDATES.replace(B.ALL_ISSUES, _OPEN)}, {_choose('0.0::DOUBLE')}
  SELECT row_id, agent, action_type, col AS "column", value, round(score, 6) AS score FROM best WHERE rn = 1"""


def _decision(df):
    return df.select("row_id", "decision.agent", "decision.action_type", "decision.column", "decision.value", F.round("decision.score", 6).alias("score"))


@query("stream_decide", f"WITH {_DECIDE}")
def stream_decide(spark, sf):
    s = T.stream_decide(_dirty_single(B.people_of(T.stream_table(spark, sf, "customer"))).drop("truth"))
    return _decision(T.run_available(s, scratch_path(spark, "decide"), scratch_path(spark, "state")))


@query("stream_decide_batch_twin", f"WITH {_DECIDE}")
def stream_decide_batch_twin(spark, sf):
    return _decision(T.stream_decide(_dirty_single(B.people(spark, sf)).drop("truth")))


@query("stream_clean_batch_twin", f"WITH {_CLEAN}")
def stream_clean_batch_twin(spark, sf):
    out = T.stream_clean(_dirty_single(B.people(spark, sf)), "hard")
    return out.withColumn("issues", F.array_join("issues", ",")).select(_CLEAN_COLS)


@query("stream_dedupe", """SELECT event_id, user_id, event_type, value FROM events""")
def stream_dedupe(spark, sf):
    e = T.stream_table(spark, sf, "events").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    d = T.stream_dedupe(e, ["event_id"], "ts").select("event_id", "user_id", "event_type", "value")
    return T.run_available(d, scratch_path(spark, "dedupe"), scratch_path(spark, "state"))


def _value(e):
    """A quarter of the values missing, the others a thousandfold, so that some are outliers."""
    return e.withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value") * 1000))


_WINDOWED = """v AS (SELECT ts, event_type, CASE WHEN event_id % 4 <> 0 THEN value * 1000 END AS value FROM events),
w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS m, count(*) FILTER (value > 200000 OR value < 0) AS o, sum(value) AS t FROM v GROUP BY 1, 2)"""
_WINDOW_OUT = """strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M') AS window_end, event_type, n AS "rows", m AS missing, round(m / n::DOUBLE, 6) AS missing_pct, o AS outliers, round(t, 4) AS total"""


def _window_out(df):
    return df.withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm"), "window_end": F.date_format("window_end", "yyyy-MM-dd HH:mm"),
        "missing_pct": F.round("missing_pct", 6), "total": F.round("total", 4)})


@query("window_quality", f"""WITH {_WINDOWED} SELECT {_WINDOW_OUT} FROM w""")
def window_quality(spark, sf):
    return _window_out(T.window_quality(_value(B.table(spark, sf, "events")), "ts", "value", "1 hour", by=["event_type"]))


@query("window_quality_sliding", """WITH v AS (SELECT ts, CASE WHEN event_id % 4 <> 0 THEN value * 1000 END AS value FROM events),
  k AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * i) AS s, value FROM v, (SELECT unnest([0, 1]) AS i) x)
  SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M') AS window_end, count(*) AS "rows", count(*) FILTER (value IS NULL) AS missing, round(count(*) FILTER (value IS NULL) / count(*)::DOUBLE, 6) AS missing_pct,
    count(*) FILTER (value > 200000 OR value < 0) AS outliers, round(sum(value), 4) AS total FROM k GROUP BY s""")
def window_quality_sliding(spark, sf):
    return _window_out(T.window_quality(_value(B.table(spark, sf, "events")), "ts", "value", "1 hour", "30 minutes"))


@query("stream_quality", f"""WITH {_WINDOWED} SELECT {_WINDOW_OUT} FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_quality(spark, sf):
    s = T.stream_quality(_value(T.stream_table(spark, sf, "events")), "ts", "value", "1 hour", by=["event_type"])
    return _window_out(T.run_available(s, scratch_path(spark, "quality"), scratch_path(spark, "state")))


@query("stream_agent_history", f"""WITH {B.DECISIONS}, r AS (SELECT agent, reward, row_number() OVER (PARTITION BY agent ORDER BY row_id DESC) AS n FROM decisions) SELECT agent, round(avg(reward), 6) AS reward_avg, count(*) AS kept FROM r WHERE n <= 100 GROUP BY agent""")
def stream_agent_history(spark, sf):
    path = scratch_path(spark, "history")
    q = T.stream_agent_history(B.decisions_of(T.stream_table(spark, sf, "events")), path, scratch_path(spark, "state"))
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    return T.snapshot_averages(spark, path, last).withColumn("reward_avg", F.round("reward_avg", 6))


@query("stream_audit", f"""WITH {B.AUDIT} SELECT action_type, count(*) AS n, round(sum(reward), 4) AS reward FROM audit GROUP BY 1""")
def stream_audit(spark, sf):
    path = scratch_path(spark, "audit")
    T.stream_audit(B.audit_of(T.stream_table(spark, sf, "lineitem")), path, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(path).groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("reward"))


_SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '6 hours' AS b, count(*) AS events FROM n GROUP BY user_id, no)"""
_SESSION_OUT = "user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, events"


def _session_out(df):
    return df.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
                     F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "events")


@query("session_summary", f"""WITH {_SESSIONS} SELECT {_SESSION_OUT} FROM s""")
def session_summary(spark, sf):
    return _session_out(T.session_summary(B.table(spark, sf, "events"), "user_id", "ts", 6 * 3600))


@query("stream_sessions", f"""WITH {_SESSIONS} SELECT {_SESSION_OUT} FROM s WHERE b <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_sessions(spark, sf):
    s = T.stream_sessions(T.stream_table(spark, sf, "events"), "user_id", "ts", "6 hours")
    return _session_out(T.run_available(s, scratch_path(spark, "sessions"), scratch_path(spark, "state")))
