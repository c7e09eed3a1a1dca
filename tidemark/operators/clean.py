"""Repairs. Column repairs collapse into one projection; removals work on pre-aggregated keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions.similarity import length_bound, matcher, within_edits
from tidemark.operators.quantiles import attach_quantiles
from tidemark.operators.segments import null_safe, with_rank

MAX_LITERAL_MAP = 1000


def _type(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells become NULL, so that there is one kind of missing number."""
    fixes = {f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(fixes) if fixes else df


def fill_value(df: DataFrame, c: str, value, mode: str = "blank") -> DataFrame:
    t = _type(df, c)
    return df.withColumn(c, F.when(P.missing(F.col(c), mode, t), F.lit(value).cast(t)).otherwise(F.col(c)))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] | None = None, mode: str = "blank") -> DataFrame:
    defaults = vocab.FILL_DEFAULTS if defaults is None else defaults
    cols = {}
    for c, v in defaults.items():
        if c in df.columns:
            t = _type(df, c)
            cols[c] = F.when(P.missing(F.col(c), mode, t), F.lit(v).cast(t)).otherwise(F.col(c))
    return df.withColumns(cols) if cols else df


def mode_value(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value (smallest on ties) as column ``mode``, from pre-aggregated counts."""
    t = _type(df, c)
    counts = df.filter(~P.missing(F.col(c), "blank", t)).groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(c).alias("v")))["v"].alias("mode"))


def fill_stat(df: DataFrame, c: str, how: str = "median", by: Sequence[str] = ()) -> DataFrame:
    """Fill with the median, mean or mode of the column, per group if ``by`` is given."""
    t = _type(df, c)
    if how == "median":
        out, q = attach_quantiles(df, [c], [0.5], by)
        fill = q[c, 0]
    else:
        if how == "mean":
            v = F.col(c).cast("double")
            stat = df.groupBy(*by).agg(F.avg(F.when(~F.isnan(v), v)).alias("__fill"))
        elif how == "mode":
            stat = mode_value(df, c, by).withColumnRenamed("mode", "__fill")
        else:
            raise ValueError(f"unknown statistic: {how}")
        if by:
            out, fill = null_safe(df, stat, by, "left"), F.col("__fill")
        else:
            out, fill = df, stat.scalar()
    filled = F.when(P.missing(F.col(c), "blank", t), fill.cast(t)).otherwise(F.col(c))
    return out.withColumn(c, filled).select(*df.columns)


def fix_type(df: DataFrame, c: str, failed: str | None = None) -> DataFrame:
    """Text to DOUBLE; ``failed`` names a flag column for cells that did not parse."""
    src = F.col(c)
    out = df.withColumn(failed, P.non_numeric_text(src)) if failed else df
    return out.withColumn(c, P.parse_number(src))


def fix_type_cell(c: Column) -> Column:
    """In a text column: numbers in canonical float form, anything else left alone."""
    return F.coalesce(P.parse_number(c).cast("string"), c)


def fix_type_lenient(df: DataFrame, c: str) -> DataFrame:
    """Leading number of the text (``85 points``) as DOUBLE."""
    return df.withColumn(c, leading_number(F.col(c)))


def leading_number(c: Column) -> Column:
    found = F.regexp_extract(c, r"^\s*([+-]?[0-9]+([.][0-9]+)?)", 1)
    return F.when(found != "", found).cast("double")


def fix_formatting(c: Column) -> Column:
    return P.strip(F.lower(c))


def category_lookup(c: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """The mapped value, NULL where the text is no key. Large mappings plan better as a table (``joins.lookup_category``)."""
    mapping = vocab.CATEGORY_MAP if mapping is None else mapping
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def fix_category_map(df: DataFrame, c: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumn(c, F.coalesce(category_lookup(F.col(c), mapping), F.col(c)))


def fuzzy_category(c: Column, known: Sequence[str], threshold: float = vocab.FUZZY_THRESHOLD) -> Column:
    """Closest known value of a text, or the text itself.

    Exact hits and hopeless texts are settled natively; only the known values that pass the length
    and edit bounds go to the matcher, each distinct text of a batch once. No shuffle, so frequent
    values do no harm.
    """
    known = list(known)
    text = P.strip(F.lower(c))
    near = F.filter(
        F.array(*[F.lit(k) for k in known]),
        lambda k: (length_bound(text, k) >= threshold - 1e-9) & within_edits(text, k, threshold),
    )
    todo = F.when(~text.isin(known) & (F.size(near) > 0), F.concat_ws("\x00", text, near))

    make = matcher()

    @F.pandas_udf(T.StringType())
    def best_match(s: pd.Series) -> pd.Series:
        best, ratio = {}, make()
        for packed in s.dropna().unique():
            value, *options = packed.split("\x00")
            ratios = [ratio(value, o) for o in options]
            top = max(ratios)
            best[packed] = options[ratios.index(top)] if top >= threshold else None
        return s.map(best).astype(object).where(s.notna(), None)

    return F.when(text.isin(known), text).otherwise(F.coalesce(best_match(todo), c))


def fix_category_fuzzy(df: DataFrame, c: str, known: Sequence[str] | None = None,
                       threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """Closest known value per cell, alike for lists of any length; a long one is taken as a table and met through shared tokens."""
    if known is not None and len(known) > MAX_LITERAL_MAP:
        from tidemark.operators.fuzzy import closest_known

        rows = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(known)], "value string, pos int")
        return closest_known(df, c, rows, threshold)
    return df.withColumn(c, fuzzy_category(F.col(c), vocab.KNOWN_CATEGORIES[c] if known is None else known, threshold))


def email_with_known_domain(c: Column, known: Sequence[str] | None = None) -> Column:
    """The address with the closest known domain; what stands before the @ stays."""
    known = vocab.KNOWN_CATEGORIES["email"] if known is None else known
    user, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    return F.when(c.contains("@"), F.concat(user, F.lit("@"), fuzzy_category(domain, known))).otherwise(c)


def fix_email_domain(df: DataFrame, c: str = "email", known: Sequence[str] | None = None) -> DataFrame:
    """Opt-in: match the domain part only, the address before the @ stays."""
    return df.withColumn(c, email_with_known_domain(F.col(c), known))


def replace_outlier_const(df: DataFrame, c: str, value=vocab.RANGE_REPLACEMENT, lo=vocab.RANGE_LOW,
                          hi=vocab.RANGE_HIGH) -> DataFrame:
    return df.withColumn(c, F.when(P.outlier_range(F.col(c), lo, hi), F.lit(value).cast(_type(df, c))).otherwise(F.col(c)))


def replace_outlier_typical(df: DataFrame, c: str) -> DataFrame:
    """Outside the typical fences -> the typical median."""
    q1, q3 = vocab.TYPICAL_QUARTILES[c]
    fixed = F.lit(vocab.TYPICAL_MEDIANS[c]).cast(_type(df, c))
    return df.withColumn(c, F.when(P.outlier_fixed(F.col(c), q1, q3), fixed).otherwise(F.col(c)))


def replace_outlier_median(df: DataFrame, c: str, k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Outside the fences of the data -> the median of the data."""
    out, q = attach_quantiles(df, [c], [0.25, 0.5, 0.75], by)
    lo, hi = P.fence(q[c, 0], q[c, 2], k)
    bad = (F.col(c) < lo) | (F.col(c) > hi)
    return out.withColumn(c, F.when(bad, q[c, 1].cast(_type(df, c))).otherwise(F.col(c))).select(*df.columns)


def cap_outlier(df: DataFrame, c: str, k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Clip to the fences of the data."""
    out, q = attach_quantiles(df, [c], [0.25, 0.75], by)
    lo, hi = P.fence(q[c, 0], q[c, 1], k)
    clipped = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), lo), hi)).cast(_type(df, c))
    return out.withColumn(c, clipped).select(*df.columns)


def repeated_keys(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """The keys that occur more than once (NULLs equal), with the order value ``__first`` of their first row.

    Partial aggregates fold copies before the exchange, so a key that holds a third of the table costs one
    row per task; keys without copies are dropped, so the result is as small as the duplication.
    """
    counted = df.groupBy(*keys).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    return counted.filter(F.col("__n") > 1).drop("__n")


def _with_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    # one row per key on the right: broadcast when small, else a merge join whose hot keys are split at run time
    return null_safe(df, repeated_keys(df, keys, order), keys, "left")


def drop_duplicates_on(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """Keep the first row of every key."""
    first = F.col("__first").isNull() | (F.col(order) == F.col("__first"))
    return _with_first(df, keys, order).filter(first).drop("__first")


def flag_duplicates(df: DataFrame, keys: Sequence[str] | None = None, order: str = "row_id",
                    name: str = "is_duplicate") -> DataFrame:
    """Mark every row that has an earlier equal one (on all columns but the order unless keys are given)."""
    keys = [c for c in df.columns if c != order] if keys is None else list(keys)
    later = F.coalesce(F.col(order) > F.col("__first"), F.lit(False))
    return _with_first(df, keys, order).withColumn(name, later).drop("__first")


def dup_exists(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """The rows that have an earlier equal row."""
    out = null_safe(df, repeated_keys(df, keys, order), keys, "inner")
    return out.filter(F.col(order) > F.col("__first")).drop("__first")


def duplicate_ordinal(df: DataFrame, keys: Sequence[str], order: str = "row_id", name: str = "nth") -> DataFrame:
    return with_rank(df, keys, order, name=name)
