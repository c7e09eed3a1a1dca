"""The row-wise work and the windowed reports as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.operators.detect import Rule, detect_issues, people_rules
from tidemark.operators.history import last_rewards
from tidemark.plans.cleaning import clean, decide, stateless
from tidemark.session import remove_folder


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, into files, and give back what was written (for queries and backfills; a running stream is
    started with the caller's own trigger)."""
    q = (sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)


def with_event_time(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``; timestamps without a zone are taken in the session's zone."""
    if isinstance(sdf.schema[ts].dataType, T.TimestampNTZType):
        sdf = sdf.withColumn(ts, F.col(ts).cast("timestamp"))
    return sdf.withWatermark(ts, delay)


def stream_clean(sdf: DataFrame, plan: str = "hard", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Issues found, then the stateless steps of the plan - the same columns as in batch."""
    found = detect_issues(sdf, people_rules(sdf) if rules is None else rules)
    return clean(found, stateless(plan))


def stream_decide(sdf: DataFrame, plan: str = "hard", fuzzy: bool = True, history: DataFrame | None = None) -> DataFrame:
    """Issues, one decision per row (duplicates need other rows, so none are marked here), then the stateless steps of the plan.
    ``history`` is a static table of agents' rewards, such as a snapshot of ``stream_agent_history``."""
    decided = decide(sdf, people_rules(sdf, outliers=True), None, fuzzy, history)
    return clean(decided.drop("legal"), stateless(plan))


def stream_dedupe(sdf: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop re-arrivals within the delay; rows later than the watermark are dropped."""
    return with_event_time(sdf, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def window_quality(df: DataFrame, ts: str, value: str, window: str, slide: str | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing share and outlying values per window; works on batch and streaming frames."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    t = df.schema[value].dataType
    gap = P.missing(F.col(value), "na", t)
    out = df.groupBy(span.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("missing"),
        F.count_if(P.outlier_range(F.col(value))).alias("outliers"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows", "missing",
                      (F.col("missing") / F.col("rows")).alias("missing_pct"), "outliers", "total")


def stream_quality(sdf: DataFrame, ts: str, value: str, window: str, delay: str = "10 minutes",
                   slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    return window_quality(with_event_time(sdf, ts, delay), ts, value, window, slide, by)


def stream_agent_history(sdf: DataFrame, path: str, checkpoint: str, n: int = vocab.HISTORY_LENGTH,
                         trigger: dict | None = None) -> StreamingQuery:
    """Keep the newest n rewards per agent (agent, row_id, reward) as a snapshot table per micro-batch.

    A batch is cut down to n rows per agent and task before anything is exchanged, so an agent that makes
    most of the decisions costs no more than the others. Snapshots are named by batch, hence a batch that
    runs twice writes the same one. The one before stays for that, older ones go.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("agent", "row_id", "reward")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/v{batch_id - 1}"))
        newest(rows, n).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        if batch_id > 1:
            remove_folder(spark, f"{path}/v{batch_id - 2}")

    return (sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def newest(rows: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("agent").orderBy(F.col("row_id").desc()))
    return rows.withColumn("__r", r).filter(F.col("__r") <= n).drop("__r")


def snapshot_averages(spark: SparkSession, path: str, version: int) -> DataFrame:
    return last_rewards(spark.read.parquet(f"{path}/v{version}"))


def stream_audit(sdf: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Audit rows into one folder per batch; a repeated batch overwrites its own folder only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_sessions(sdf: DataFrame, key: str, ts: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    g = with_event_time(sdf, ts, delay).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def session_summary(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Batch twin: one row per session (key, session_start, session_end, events). Rows without a time are in no session.

    A session starts where the gap to the key's previous row is too wide. Rows fold into summaries that merge in any order: first
    and last time and count per stretch of one gap's length, whose rows are one session in any case. Only these move: a key has
    at most as many as the time covered has stretches, however many rows it holds. Neighbouring summaries then merge.
    """
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    micros, width = F.unix_micros(F.col(ts).cast("timestamp")), F.lit(gap_seconds * 1_000_000)
    slot = F.call_function("div", micros - F.pmod(micros, width), width)
    folded = df.where(F.col(ts).isNotNull()).groupBy(key, slot.alias("__slot")).agg(
        F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key).orderBy("__slot")
    last = F.lag("__to").over(w)
    numbered = folded.withColumn("__start", F.when(last.isNull() | (F.col("__from") >= last + gap), 1).otherwise(0)).withColumn(
        "__session", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__session").agg(
        F.min("__from").alias("session_start"), (F.max("__to") + gap).alias("session_end"), F.sum("__n").alias("events")).drop("__session")
