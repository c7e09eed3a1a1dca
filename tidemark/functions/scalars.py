"""Scalar helpers: hashing gates, clamps, texts, JSON and array helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

HASH_SPACE = float(2**32)


def hash32(*parts) -> Column:
    """The first 32 bits of md5 over the parts, as LONG. Reproducible in any SQL engine."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Hash-derived number in [0, 1)."""
    return hash32(*parts) / F.lit(HASH_SPACE)


def gate(rate: float, *parts) -> Column:
    """True for a ``rate`` share of keys."""
    return uniform(*parts) < F.lit(float(rate))


def pick(options: list, *parts) -> Column:
    """Hash-chosen element of a short literal list."""
    idx = F.pmod(hash32(*parts), F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def labels(pairs: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in order. Unlike filtering with a lambda, this stays in
    generated code together with the conditions."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*[F.when(cond, F.lit(label)).otherwise(F.lit("")) for cond, label in pairs]), "")


def joined_issues(issues: Column) -> Column:
    """The issues in one text, each behind a mark: generated code can search it, a lambda over the array
    would leave generated code."""
    return F.concat(F.lit("\x01"), F.array_join(issues, "\x01"))


def any_issue(issues: Column, *, prefix: str | None = None, part: str | None = None) -> Column:
    """Whether any issue text starts with ``prefix`` / contains ``part``."""
    return joined_issues(issues).contains(part if prefix is None else "\x01" + prefix)


def count_issues(issues: Column, *parts: str) -> Column:
    """How many issues contain one of the parts."""
    either = "|".join(re.escape(p) for p in parts)
    return F.regexp_count(joined_issues(issues), F.lit(f"\x01[^\x01]*?(?:{either})[^\x01]*"))


def first_issue_column(issues: Column, kind: str) -> Column:
    """Column named by the first issue of a kind, NULL if there is none."""
    return F.nullif(F.regexp_extract(joined_issues(issues), f"\x01{re.escape(kind)}:([^\x01]+)", 1), F.lit(""))


def elapsed_text(start: Column, end: Column) -> Column:
    """``Xh Ym``, or ``Ym`` below an hour; NULL while either end is missing."""
    minutes = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)
    hours = F.floor(minutes / 60)
    rest = (minutes % 60).cast("string")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest, F.lit("m"))).otherwise(
        F.concat(rest, F.lit("m"))
    )


def eta_minutes(start: Column, now: Column, done: Column, total: Column) -> Column:
    """Minutes left at the rate so far, rounded up; NULL before the first row."""
    spent = F.unix_timestamp(now) - F.unix_timestamp(start)
    return F.when((done > 0) & (spent > 0), F.ceil((total - done) * spent / (done * 60.0)))


def eta_text(minutes: Column) -> Column:
    hours = F.concat(F.lit("~"), F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return (
        F.when(minutes.isNull(), F.lit("Calculating..."))
        .when(minutes > 60, hours)
        .otherwise(F.concat(F.lit("~"), minutes.cast("string"), F.lit("m")))
    )


def human_size(c: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    def unit(power: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", c / float(1024**power)), F.lit(" " + name))

    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024**2, unit(1, "KB"))
        .when(c < 1024**3, unit(2, "MB"))
        .otherwise(unit(3, "GB"))
    )


def json_field(c: Column, schema: str) -> Column:
    """Parsed JSON; text that is not JSON becomes NULL."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


def email_domain(c: Column) -> Column:
    return F.when(c.contains("@"), F.split_part(c, F.lit("@"), F.lit(2)))


def fixed_length(c: Column, n: int) -> Column:
    """Array padded with zeros, or cut, to n elements."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), n)), 1, n)
