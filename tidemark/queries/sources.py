"""Readers and writers, on whole tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.history import to_transitions
from tidemark.queries import base as B
from tidemark.queries.registry import query
from tidemark.queries.scores import sql_quality, sql_score
from tidemark.session import scratch_path
from tidemark.sources import files, tables

ROW = ["row_id", "id", "name", "age", "salary", "score", "dept", "email"]


@query("csv_round_trip", f"""WITH {B.DIRTY} SELECT row_id, id, name, age, salary, score, dept, email FROM dirty""")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(B.dirty(spark, sf).select(ROW), path)
    return files.scan_csv(spark, path)


@query("csv_with_schema", f"""WITH {B.DIRTY} SELECT row_id, name, age::DOUBLE AS age, {B.sql_number('score')} AS score FROM dirty""")
def csv_with_schema(spark, sf):
    path = scratch_path(spark, "csv")
    d = B.dirty(spark, sf)
    files.write_csv(d.select("row_id", "name", F.coalesce(F.col("age").cast("string"), F.lit("NA")).alias("age"), F.coalesce("score", F.lit("null")).alias("score")), path)
    return files.scan_csv(spark, path, "row_id bigint, name string, age double, score double")


@query("json_report", f"""WITH {B.RUNS} SELECT version, difficulty, final_reward, epochs FROM runs""")
def json_report(spark, sf):
    path = scratch_path(spark, "json")
    r = B.runs(spark, sf).select("version", "difficulty", "final_reward", "epochs")
    files.write_report_json(r, path)
    return files.scan_json(spark, path, r.schema)


_CATALOG = {"nation": "n_nationkey,n_name,n_regionkey", "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
            "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal", "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice"}


@query("dataset_catalog", " UNION ALL ".join(
    f"""SELECT '{t}.parquet' AS file, '{c}' AS "columns", "rows", round(missing / ("rows" * {c.count(',') + 1})::DOUBLE, 6) AS missing_pct, duplicates, round({sql_score(c.count(',') + 1)}, 6) AS quality_score FROM {sql_quality(t, c.split(','))}"""
    for t, c in _CATALOG.items()))
def dataset_catalog(spark, sf):
    c = files.dataset_catalog(spark, [f"{sf}/{t}.parquet" for t in _CATALOG])
    return c.select(F.substring_index("file", "/", -1).alias("file"), "columns", "rows", "missing_pct", "duplicates", "quality_score")


@query("append_audit", f"""WITH {B.AUDIT} SELECT action_type, agent_used, count(*) AS n, round(sum(reward), 4) AS reward, count(DISTINCT job_id) AS jobs FROM audit GROUP BY 1, 2""")
def append_audit(spark, sf):
    path = scratch_path(spark, "audit")
    a = B.audit(spark, sf)
    for half in (0, 1):
        tables.append_audit(a.filter(F.col("job_id") % 2 == half), path)
    return tables.read_audit(spark, path).groupBy("action_type", "agent_used").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("reward"), F.count_distinct("job_id").alias("jobs"))


@query("stored_transitions", f"""WITH {B.DECISIONS} SELECT row_id, confidence AS state, coalesce(lead(confidence) OVER (PARTITION BY episode ORDER BY step), confidence) AS next_state, lead(row_id) OVER (PARTITION BY episode ORDER BY step) IS NULL AS done FROM decisions""")
def stored_transitions(spark, sf):
    path = scratch_path(spark, "transitions")
    tables.save_transitions(to_transitions(B.decisions(spark, sf).withColumn("state", F.col("confidence"))), path)
    return tables.load_transitions(spark, path).select("row_id", "state", "next_state", "done")
