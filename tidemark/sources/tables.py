"""Stored tables: the audit log and the transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AUDIT_COLUMNS = ["id", "job_id", "action_type", "row_index", "column", "old_value", "new_value", "reward",
                 "agent_used", "confidence", "timestamp"]
AUDIT_BUCKETS = 64


def _bucket(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id.cast("string")), F.lit(buckets)).cast("int")


def audit_rows(actions: DataFrame, job_id, at: Column) -> DataFrame:
    """Audit rows of one job from applied actions (agent and confidence are kept where present)."""
    has = set(actions.columns)
    return actions.select(
        F.concat_ws("-", F.lit(str(job_id)), F.col("row_id").cast("string")).alias("id"),
        F.lit(str(job_id)).alias("job_id"), "action_type", F.col("row_id").alias("row_index"), "column",
        F.to_json(F.struct(F.col("old_value").alias("v"))).alias("old_value"),
        F.to_json(F.struct(F.col("new_value").alias("v"))).alias("new_value"),
        F.col("reward").cast("double").alias("reward"),
        (F.col("agent") if "agent" in has else F.lit(None).cast("string")).alias("agent_used"),
        (F.col("confidence") if "confidence" in has else F.lit(None).cast("double")).alias("confidence"),
        at.alias("timestamp"))


def append_audit(audit: DataFrame, path: str, buckets: int = AUDIT_BUCKETS) -> None:
    """Append audit rows. Folders are job buckets, so their count does not grow with the jobs: choose ``buckets`` when the log
    is begun and keep it. Rows are rebalanced over them and large buckets split, so a huge job makes several files; within
    a file rows are sorted by job, so a job's lookup skips the row groups of others."""
    audit.withColumn("job_bucket", _bucket(F.col("job_id"), buckets)).hint("rebalance", "job_bucket") \
        .sortWithinPartitions("job_bucket", "job_id").write.mode("append").partitionBy("job_bucket").parquet(path)


def read_audit(spark: SparkSession, path: str, job_id=None, buckets: int = AUDIT_BUCKETS) -> DataFrame:
    """The log, or one job's part of it: only that job's bucket is opened. ``buckets`` is what the log was begun with."""
    df = spark.read.parquet(path)
    if job_id is not None:
        df = df.filter((F.col("job_bucket") == _bucket(F.lit(str(job_id)), buckets)) & (F.col("job_id") == str(job_id)))
    return df.drop("job_bucket")


def save_transitions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
