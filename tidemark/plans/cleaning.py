"""Cleaning plans and the batch job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.operators import clean as C
from tidemark.operators.actions import apply_decisions, cleaned_rows
from tidemark.operators.decide import choose_action, default_specialists, recommend
from tidemark.operators.detect import Rule, detect_issues, legal_actions, people_rules
from tidemark.operators.quality import compare_quality
from tidemark.operators.rewards import batch_reward
from tidemark.session import cut
from tidemark.sources.tables import audit_rows

Step = Callable[[DataFrame], DataFrame]


def _only(names: Sequence[str], step: Callable[[DataFrame, str], DataFrame]) -> Step:
    """A step over those of the named columns that the table has."""
    def run(df: DataFrame) -> DataFrame:
        for n in names:
            if n in df.columns:
                df = step(df, n)
        return df

    return run


def _dedupe(df: DataFrame) -> DataFrame:
    return C.drop_duplicates_on(df, [k for k in ("name", "email") if k in df.columns])


def _score_type(df: DataFrame, c: str) -> DataFrame:
    return C.fix_type(df, c) if isinstance(df.schema[c].dataType, T.StringType) else df


def _lower(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, C.fix_formatting(F.col(c)))


PLANS: dict[str, list[Step]] = {
    "easy": [C.fill_defaults, _only(["score"], _score_type)],
    "medium": [_dedupe, C.fill_defaults, _only(["email"], _lower)],
    "hard": [
        _dedupe,
        C.fill_defaults,
        _only(["score"], lambda df, c: C.fix_type_lenient(df, c) if isinstance(df.schema[c].dataType, T.StringType) else df),
        _only(["email"], _lower),
        _only(["dept"], C.fix_category_map),
        _only(["salary"], C.replace_outlier_const),
        _only(["age", "score"], C.replace_outlier_typical),
    ],
}


def clean(df: DataFrame, plan: str | Sequence[Step]) -> DataFrame:
    """Run a named plan or a list of steps; the column steps collapse into one projection."""
    if isinstance(plan, str):
        if plan not in PLANS:
            raise ValueError(f"unknown plan: {plan}")
        plan = PLANS[plan]
    for step in plan:
        df = step(df)
    return df


def stateless(plan: str) -> list[Step]:
    """The steps of a plan that look at one row only (for streams)."""
    return [s for s in PLANS[plan] if s is not _dedupe]


@dataclass
class CleaningJob:
    """Lazy results of a batch job."""

    decided: DataFrame
    applied: DataFrame
    cleaned: DataFrame
    audit: DataFrame
    metrics: DataFrame


def with_duplicate_issue(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Add ``duplicate:row`` to the issues of rows with an earlier equal key."""
    flagged = C.flag_duplicates(df, keys, row_id, "__dup")
    return flagged.withColumn("issues", F.when(F.col("__dup"), F.array_append("issues", F.lit("duplicate:row")))
                              .otherwise(F.col("issues"))).drop("__dup")


def decide(df: DataFrame, rules: Sequence[Rule] | None = None, keys: Sequence[str] | None = ("name", "email"),
           fuzzy: bool = True, history: DataFrame | None = None, first: str = "id", mode: str = "na") -> DataFrame:
    """Issues, legal actions and one decision per row."""
    d = detect_issues(df, people_rules(df, outliers=True, mode=mode) if rules is None else rules)
    if keys:
        d = with_duplicate_issue(d, keys)
    d = d.withColumn("legal", legal_actions(F.col("issues")))
    d = recommend(d, default_specialists(df, F.col("issues"), F.col("legal"), fuzzy, first=first))
    return choose_action(d, history=history).drop("candidates")


def cleaning_job(df: DataFrame, job_id: str, at: Column, rules: Sequence[Rule] | None = None,
                 keys: Sequence[str] = ("name", "email"), fuzzy: bool = True,
                 history: DataFrame | None = None) -> CleaningJob:
    """Detect, decide, apply, log and measure. Null, NaN and blank cells are missing alike, and what was decided is written.

    Decisions are made once and written to the shared folder, and so are the applied rows; the results read those.
    """
    decided = cut(decide(df, rules, keys, fuzzy, history, mode="blank"), "decided")
    applied = cut(apply_decisions(decided, "decision", df.columns, keys, carry=["issues", "decision"], proposed=True, mode="blank"), "applied")
    logged = applied.withColumns({
        "agent": F.col("decision.agent"), "confidence": F.col("decision.confidence"),
        "reward": batch_reward(F.col("action_type"), F.col("issues"))})
    cleaned = cleaned_rows(applied, df.columns)
    return CleaningJob(decided, applied, cleaned, audit_rows(logged, job_id, at), compare_quality(df, cleaned))
