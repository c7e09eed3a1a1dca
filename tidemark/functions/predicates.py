"""Cell-level detection predicates. Every function returns a Column and stays inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from tidemark import vocab

# What Python's float() takes as a number, as a pattern (digit groups may hold single underscores).
_DIGITS = r"[0-9]+(_[0-9]+)*"
NUMERIC_PATTERN = (
    rf"^\s*[+-]?((({_DIGITS})([.]({_DIGITS})?)?|[.]{_DIGITS})([eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)


def strip(c: Column) -> Column:
    """Trim all the whitespace characters, not only blanks."""
    return F.btrim(c, F.lit(vocab.WHITESPACE))


def missing(c: Column, mode: str = "blank", dtype: T.DataType | None = None) -> Column:
    """``null``: NULL only; ``na``: NULL or NaN; ``blank``: also text of nothing but whitespace."""
    out = c.isNull()
    if mode == "null":
        return out
    if mode not in ("na", "blank"):
        raise ValueError(f"unknown missing mode: {mode}")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = out | F.isnan(c)
    if mode == "blank" and isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        out = out | (strip(c) == "")
    return out


def numeric_text(c: Column) -> Column:
    """Text that parses as a float."""
    return F.coalesce(c.rlike(NUMERIC_PATTERN), F.lit(False))


def parse_number(c: Column) -> Column:
    """Text to DOUBLE by the rules of :func:`numeric_text`; NULL where it does not parse."""
    plain = F.regexp_replace(strip(c), "_", "")
    return F.when(numeric_text(c), plain.try_cast("double"))


def non_numeric_text(c: Column) -> Column:
    """A filled cell of a column that should be numeric but does not parse."""
    return c.isNotNull() & ~numeric_text(c)


def has_upper(c: Column) -> Column:
    return F.coalesce(c != F.lower(c), F.lit(False))


def bad_email(c: Column) -> Column:
    return F.coalesce(~c.contains("@") | c.contains(" at "), F.lit(False))


def bad_name(c: Column, trim: bool = False) -> Column:
    """Double blank or underscore; with ``trim`` also leading or trailing whitespace."""
    out = c.contains("  ") | c.contains("_")
    if trim:
        out = out | (c != strip(c))
    return F.coalesce(out, F.lit(False))


def unknown_category(c: Column, known: Sequence[str]) -> Column:
    return F.coalesce(~c.isin(list(known)), F.lit(False))


def fence(q1, q3, k: float = 1.5) -> tuple:
    """Lower and upper fence of two quartiles; takes numbers or Columns."""
    return q1 - (q3 - q1) * k, q3 + (q3 - q1) * k


def outlier_fixed(c: Column, q1: float, q3: float, k: float = 1.5) -> Column:
    lo, hi = fence(q1, q3, k)
    return F.coalesce((c < lo) | (c > hi), F.lit(False))


def outlier_range(c: Column, lo: float = vocab.RANGE_LOW, hi: float = vocab.RANGE_HIGH) -> Column:
    return F.coalesce((c < lo) | (c > hi), F.lit(False))


def outlier_confidence(c: Column, column: str) -> Column:
    """0.9, 0.7 or 0.5 by how far out the value is; columns without bands get 0.5."""
    if column not in vocab.OUTLIER_BANDS:
        return F.lit(0.5)
    (lo9, hi9), (lo7, hi7) = vocab.OUTLIER_BANDS[column]
    return (
        F.when((c < lo9) | (c > hi9), F.lit(0.9)).when((c < lo7) | (c > hi7), F.lit(0.7)).otherwise(F.lit(0.5))
    )


def value_kind(c: Column, dtype: T.DataType) -> Column:
    """null, int, float, bool or string."""
    if isinstance(dtype, T.BooleanType):
        kind = F.lit("bool")
    elif isinstance(dtype, T.IntegralType):
        kind = F.lit("int")
    elif isinstance(dtype, (T.FractionalType, T.DecimalType)):
        kind = F.when(c == F.floor(c), F.lit("int")).otherwise(F.lit("float"))
    else:
        kind = F.lit("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(kind)


def search(cols: Sequence[Column], term: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c.cast("string")).contains(term.lower()), F.lit(False))
    return hit


def band(c: Column, cuts: Sequence[tuple[float, str]], low: str = "low") -> Column:
    """Label of the first cut reached, cuts given from high to low."""
    out = None
    for bound, label in cuts:
        out = F.when(c >= bound, F.lit(label)) if out is None else out.when(c >= bound, F.lit(label))
    return out.otherwise(F.lit(low))


def display_value(c: Column, width: int = 50) -> Column:
    """``-`` for nothing, shortened text otherwise."""
    text = c.cast("string")
    return (
        F.when(text.isNull() | text.isin("null", ""), F.lit("-"))
        .when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("...")))
        .otherwise(text)
    )
