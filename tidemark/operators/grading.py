"""Scores of cleaned tables: named checks that pass or fail per row or per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions.scalars import clamp


@dataclass(frozen=True)
class Check:
    """A pluggable check. ``row``: a predicate counted per row; ``table``: one aggregate predicate."""

    name: str
    expr: Column
    level: str = "row"

    def __post_init__(self):
        if self.level not in ("row", "table"):
            raise ValueError(f"unknown check level: {self.level}")


def check_suite(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check (and ``*`` for all): check, passed, total, score rounded to 2; empty table -> 0."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(checks):
        ok = F.coalesce(c.expr, F.lit(False))
        aggs.append((F.count_if(ok) if c.level == "row" else ok.cast("bigint")).alias(f"p{i}"))
    flat = df.agg(*aggs)
    filled = F.col("rows") > 0
    rows = []
    for i, c in enumerate(checks):
        total = F.col("rows") if c.level == "row" else filled.cast("bigint")
        rows.append(F.struct(F.lit(c.name).alias("check"), F.when(filled, F.col(f"p{i}")).otherwise(F.lit(0)).alias("passed"),
                             total.alias("total")))
    everything = F.struct(
        F.lit("*").alias("check"),
        sum((r["passed"] for r in rows), F.lit(0).cast("bigint")).alias("passed"),
        sum((r["total"] for r in rows), F.lit(0).cast("bigint")).alias("total"),
    )
    return flat.select(F.inline(F.array(*rows, everything))).select(
        "check", F.col("passed").cast("bigint").alias("passed"), F.col("total").cast("bigint").alias("total"),
        F.round(F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0)), 2).alias("score"))


def all_distinct(c: Column) -> Column:
    """Aggregate: no value occurs twice, NULL counted as a value."""
    values = F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
    return F.count(F.lit(1)) == values


def easy_checks() -> list[Check]:
    filled = [Check(f"filled_{c}", F.col(c).isNotNull()) for c in ("age", "salary", "score")]
    return [*filled, Check("score_numeric", P.numeric_text(F.col("score").cast("string")))]


def medium_checks() -> list[Check]:
    return [
        Check("emails_unique", all_distinct(F.coalesce(F.lower("email"), F.lit(""))), "table"),
        Check("filled_name", F.col("name").isNotNull()),
        Check("email_lower", F.coalesce(F.col("email"), F.lit("")) == F.lower(F.coalesce(F.col("email"), F.lit("")))),
        Check("filled_age", F.col("age").isNotNull()),
    ]


def hard_checks() -> list[Check]:
    return [
        Check("names_unique", all_distinct(F.col("name")), "table"),
        Check("filled_name", F.col("name").isNotNull()),
        Check("filled_age", F.col("age").isNotNull()),
        Check("filled_salary", F.col("salary").isNotNull()),
        Check("dept_valid", F.col("dept").isin(vocab.VALID_DEPTS)),
        Check("salary_in_range", (F.col("salary") > vocab.RANGE_LOW) & (F.col("salary") < vocab.RANGE_HIGH)),
    ]


GRADERS = {"easy": easy_checks, "medium": medium_checks, "hard": hard_checks}


def grade(df: DataFrame, level: str) -> DataFrame:
    """One row: passed, total, score."""
    if level not in GRADERS:
        raise ValueError(f"unknown task: {level}")
    return check_suite(df, GRADERS[level]()).filter(F.col("check") == "*").select("passed", "total", "score")


def distinct_count_check(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(c).alias("values"),
                  all_distinct(F.col(c)).alias("all_distinct"))


def task_success(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Clamp the scores and mark the successes; a task without a score keeps none and is no success."""
    s = F.when(F.col(score).isNotNull(), clamp(F.col(score)))
    return df.withColumns({score: s, "success": F.coalesce(s >= threshold, F.lit(False))})


def mean_score(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean over the scored tasks, the number of tasks and of those with a score."""
    s = F.when(F.col(score).isNotNull(), clamp(F.col(score)))
    return df.agg(F.avg(s).alias("mean_score"), F.count(F.lit(1)).alias("tasks"), F.count(s).alias("scored"))
