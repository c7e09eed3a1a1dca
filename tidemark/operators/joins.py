"""Lookups between tables. Join strategy is left to Spark: sizes are known at run time, and adaptive
execution splits keys that hold much of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def jobs_with_dataset(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    return jobs.join(datasets, "dataset_id")


def audit_for_job(audit: DataFrame, job_id, descending: bool = False) -> DataFrame:
    """Audit rows of one job in time order."""
    order = [F.col("timestamp").desc(), F.col("id").desc()] if descending else ["timestamp", "id"]
    return audit.filter(F.col("job_id") == job_id).orderBy(*order)


def lookup_category(df: DataFrame, c: str, mapping: DataFrame, name: str = "canonical") -> DataFrame:
    """Canonical value from a table (value, canonical); the text itself where there is none."""
    m = mapping.select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
    out = df.join(m, df[c] == m["__value"], "left")
    return out.withColumn(name, F.coalesce("__canonical", c)).drop("__value", "__canonical")


def chosen_vs_expected(chosen: DataFrame, expected: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Decision beside the expected action, with ``correct``."""
    e = expected.select(*keys, F.col("action_type").alias("expected"))
    return chosen.join(e, list(keys)).withColumn("correct", F.col("action_type").eqNullSafe(F.col("expected")))


def unmatched(df: DataFrame, c: str, known: DataFrame) -> DataFrame:
    """Distinct values of a column that are not in the known list."""
    k = known.select(F.col(known.columns[0]).alias(c))
    return df.select(c).filter(F.col(c).isNotNull()).distinct().join(k, c, "left_anti")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = common_columns(a, b)
    return a.select(*cols).intersect(b.select(*cols))


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()
