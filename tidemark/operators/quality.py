"""Table profiles and quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.functions import predicates as P
from tidemark.functions.scalars import clamp
from tidemark.operators.quantiles import weighted_quantiles
from tidemark.session import cut


def _cells(df: DataFrame, skip: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in skip]


def missing_profile(df: DataFrame, skip: Sequence[str] = ("row_id",), mode: str = "blank") -> DataFrame:
    """Missing cells per column and for the table (column ``*``), with their share. One scan."""
    fields = _cells(df, skip)
    flat = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(P.missing(F.col(f.name), mode, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    total = sum((F.col(f"m{i}") for i in range(len(fields))), F.lit(0).cast("bigint"))
    entries = [F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").alias("missing"), F.col("rows").alias("cells"))
               for i, f in enumerate(fields)]
    entries.append(F.struct(F.lit("*").alias("column"), total.alias("missing"),
                            (F.col("rows") * len(fields)).alias("cells")))
    return flat.select(F.inline(F.array(*entries))).select(
        "column", "missing", (F.col("missing") / F.greatest("cells", F.lit(1))).alias("missing_pct"))


def duplicate_count(df: DataFrame, skip: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    cols = [f.name for f in _cells(df, skip)]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def quality(df: DataFrame, skip: Sequence[str] = ("row_id",), mode: str = "blank") -> DataFrame:
    """One row: rows, missing, missing_pct, duplicates, quality_score.

    The grouping that counts the duplicates also carries the missing cells (copies have the same
    ones), so the whole score is one scan and one exchange.
    """
    fields = _cells(df, skip)
    g = df.groupBy(*[f.name for f in fields]).agg(F.count(F.lit(1)).alias("__n"))
    gaps = sum((P.missing(F.col(f.name), mode, f.dataType).cast("int") for f in fields), F.lit(0))
    one = g.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__n") * gaps), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
    )
    pct = F.col("missing") / F.greatest(F.col("rows") * max(len(fields), 1), F.lit(1))
    score = clamp(1.0 - pct - F.col("duplicates") / F.greatest("rows", F.lit(1)))
    return one.select("rows", "missing", F.round(pct, 6).alias("missing_pct"), "duplicates",
                      F.round(score, 6).alias("quality_score"))


def compare_quality(before: DataFrame, after: DataFrame, skip: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per phase (original, cleaned) with the clamped improvement of the score."""
    both = quality(before, skip).withColumn("phase", F.lit("original")).unionByName(
        quality(after, skip).withColumn("phase", F.lit("cleaned")))
    flat = both.agg(
        F.max(F.when(F.col("phase") == "original", F.struct(*both.columns))).alias("o"),
        F.max(F.when(F.col("phase") == "cleaned", F.struct(*both.columns))).alias("c"),
    )
    gain = F.round(clamp(F.col("c.quality_score") - F.col("o.quality_score")), 6).alias("improvement")
    return flat.select(F.explode(F.array("o", "c")).alias("x"), gain).select(
        "x.phase", "x.rows", "x.missing_pct", "x.duplicates", "x.quality_score", "improvement")


def projected_metrics(before: DataFrame, skip: Sequence[str] = ("row_id",)) -> DataFrame:
    """The estimate made without cleaning: fixed shares of what was found."""
    q = quality(before, skip)
    # fixed values: share of missing cells kept, share of duplicates kept, gain in score
    kept_missing, kept_duplicates, gain = 0.35, 0.2, 0.25
    cells = F.greatest(F.col("rows") * max(len(_cells(before, skip)), 1), F.lit(1))
    pct = F.col("missing") / cells
    score = clamp(1.0 - pct - F.col("duplicates") / F.greatest("rows", F.lit(1)))
    projected = clamp(score + gain)
    return q.select(
        F.round(F.greatest(F.lit(0.0), pct * kept_missing), 6).alias("missing_pct"),
        F.floor(F.col("duplicates") * kept_duplicates).cast("bigint").alias("duplicates"),
        F.round(projected, 6).alias("quality_score"),
        F.round(clamp(projected - score), 6).alias("improvement"),
    )


def value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, v, d, n): how often each value of each column occurs, as text and, for numbers, as a double; NULL is a value.

    One scan for all columns; equal values fold before the exchange.
    """
    cells = [F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("v"),
                      (F.col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")).alias("d")) for f in fields]
    return df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.column", "x.v", "x.d").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, skip: Sequence[str] = ("row_id",), approximate: bool = False) -> DataFrame:
    """One row per column: type, rows, missing, distinct, and for numbers min, quartiles, max, outliers.

    The table is read once, into counts of each column's values; all figures come from these. ``approximate`` swaps the distinct
    counts and quartiles for sketches: no exchange of values.
    """
    fields = _cells(df, skip)
    if approximate:
        return _sketched_profile(df, fields)
    kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i, isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)))
                                             for i, f in enumerate(fields)], "column string, type string, i int, is_text boolean")
    counts = cut(value_counts(df, fields), "values")
    empty = F.col("v").isNull() | F.isnan("d") | (F.col("is_text") & (P.strip(F.col("v")) == ""))
    flat = counts.join(F.broadcast(kinds), "column").groupBy("column", "type").agg(  # a row per column of the table
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"),
        F.min("d").alias("min"), F.max("d").alias("max"))
    at = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    numbers = counts.where("d IS NOT NULL AND NOT isnan(d)").select("column", F.col("d").alias("v"), "n")
    q = weighted_quantiles(numbers, ["column"], list(at), "n", True).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == k, F.col("value"))).alias(v) for k, v in at.items()])
    lo, hi = P.fence(F.col("q1"), F.col("q3"))
    outliers = counts.join(F.broadcast(q), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when((F.col("d") < lo) | (F.col("d") > hi), F.col("n"))), F.lit(0)).alias("outliers"))
    found = kinds.select("column", "type").join(flat.drop("type"), "column", "left").join(q, "column", "left").join(outliers, "column", "left")
    return found.select("column", "type", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"),
                        F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct"), "min", "q1", "median", "q3", "max", "outliers")


def _sketched_profile(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One pass of sketches, and one for the outliers beyond their fences."""
    numeric = [f for f in fields if isinstance(f.dataType, T.NumericType)]
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count_if(P.missing(c, "blank", f.dataType)).alias(f"m{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if f in numeric:
            aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"),
                     F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias(f"q{i}")]
    none = F.lit(None).cast("double")
    flat = df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), F.col(f"m{i}").alias("missing"),
                 F.col(f"d{i}").alias("distinct"), *[(F.col(x) if f in numeric else none).alias(y) for x, y in (
                     (f"lo{i}", "min"), (f"hi{i}", "max"))],
                 *[(F.col(f"q{i}")[k].cast("double") if f in numeric else none).alias(y) for k, y in enumerate(("q1", "median", "q3"))])
        for i, f in enumerate(fields)])))
    if not numeric:
        return flat.select("column", "type", "rows", "missing", "distinct", "min", "q1", "median", "q3", "max", F.lit(None).cast("bigint").alias("outliers"))
    # one entry per column of the table
    fences = flat.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "q3")))).alias("f"))
    checked = df.select(*[f.name for f in numeric]).withColumn("__f", fences.scalar())
    outs = []
    for f in numeric:
        lo, hi = P.fence(F.col("__f")[f.name]["q1"], F.col("__f")[f.name]["q3"])
        outs.append(F.count_if((F.col(f.name) < lo) | (F.col(f.name) > hi)).alias(f.name))
    outliers = checked.agg(*outs).select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("outliers")) for f in numeric])))
    return flat.join(outliers, "column", "left").select("column", "type", "rows", "missing", "distinct", "min", "q1", "median", "q3", "max", "outliers")
