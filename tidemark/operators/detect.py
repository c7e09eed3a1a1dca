"""Issue detection: rules are plain predicates, so a table's rules run in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions.scalars import any_issue, labels
from tidemark.operators.quantiles import attach_quantiles


@dataclass(frozen=True)
class Rule:
    """A pluggable detection: rows where ``predicate`` holds get the issue ``kind:column``."""

    kind: str
    column: str
    predicate: Column

    def __post_init__(self):
        if self.kind not in vocab.ISSUE_KINDS:
            raise ValueError(f"unknown issue kind: {self.kind}")

    @property
    def issue(self) -> str:
        return f"{self.kind}:{self.column}"


def generic_rules(df: DataFrame, skip: Sequence[str] = ("row_id",), mode: str = "null") -> list[Rule]:
    """Missing for every column; numeric text and upper case for every text column, in column order."""
    rules = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f.name)
        rules.append(Rule("missing", f.name, P.missing(c, mode, f.dataType)))
        if isinstance(f.dataType, T.StringType):
            rules.append(Rule("wrong_type", f.name, P.numeric_text(c)))
            rules.append(Rule("formatting", f.name, P.has_upper(c)))
    return rules


def people_rules(df: DataFrame, trim: bool = False, outliers: bool = False, mode: str = "na") -> list[Rule]:
    """Rules of a people table (age, salary, score, name, email, dept), for the columns it has."""
    have = {f.name: f.dataType for f in df.schema.fields}
    rules = [Rule("missing", c, P.missing(F.col(c), mode, have[c])) for c in vocab.NULLABLE_COLUMNS if c in have]
    if isinstance(have.get("score"), T.StringType):
        rules.append(Rule("wrong_type", "score", P.non_numeric_text(F.col("score"))))
    if "email" in have:
        rules.append(Rule("formatting", "email", P.bad_email(F.col("email"))))
    if "name" in have:
        rules.append(Rule("formatting", "name", P.bad_name(F.col("name"), trim)))
    if "dept" in have:
        rules.append(Rule("category", "dept", P.unknown_category(F.col("dept"), vocab.DEPT_OPTIONS)))
    if outliers:
        for c, (q1, q3) in vocab.TYPICAL_QUARTILES.items():
            if c in have:
                v = P.parse_number(F.col(c)) if isinstance(have[c], T.StringType) else F.col(c)
                rules.append(Rule("outlier", c, P.outlier_fixed(v, q1, q3)))
    return rules


def blank_rules(df: DataFrame, skip: Sequence[str] = ("row_id",)) -> list[Rule]:
    """Missing only, blank text counted - what a batch job looks at."""
    return [Rule("missing", f.name, P.missing(F.col(f.name), "blank", f.dataType))
            for f in df.schema.fields if f.name not in skip]


def issues_array(rules: Sequence[Rule]) -> Column:
    return labels([(r.predicate, r.issue) for r in rules])


def detect_issues(df: DataFrame, rules: Sequence[Rule], name: str = "issues") -> DataFrame:
    return df.withColumn(name, issues_array(rules))


def explode_issues(df: DataFrame, issues: str = "issues", row_id: str = "row_id") -> DataFrame:
    """Long form: row_id, kind, column.

    The outer explode keeps the optimizer from testing the array's size first, which would evaluate all
    rules a second time.
    """
    long = df.select(row_id, F.explode_outer(issues).alias("issue")).filter(F.col("issue").isNotNull())
    return long.select(
        row_id,
        F.split_part("issue", F.lit(":"), F.lit(1)).alias("kind"),
        F.split_part("issue", F.lit(":"), F.lit(2)).alias("column"),
    )


def outlier_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = (),
                method: str = "exact") -> DataFrame:
    """Add ``<col>_outlier`` by the fences of the data's own quartiles, per group if ``by`` is given."""
    out, q = attach_quantiles(df, cols, [0.25, 0.75], by, method)
    flags = {}
    for c in cols:
        lo, hi = P.fence(q[c, 0], q[c, 1], k)
        flags[f"{c}_outlier"] = F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return out.select(*df.columns, *[v.alias(n) for n, v in flags.items()])


def legal_actions(issues: Column) -> Column:
    """Always skip, duplicate removal, category and outlier repair; fills, casts and formatting by issue."""
    always = F.lit(True)
    return labels([  # in alphabetical order
        (any_issue(issues, prefix="missing:"), "fill_missing"),
        (always, "fix_category"),
        (any_issue(issues, prefix="formatting:"), "fix_formatting"),
        (any_issue(issues, prefix="wrong_type:"), "fix_type"),
        (always, "remove_duplicate"),
        (always, "remove_outlier"),
        (always, "skip"),
    ])


def expected_action(issues: Column) -> Column:
    """What a row should get, most urgent issue first."""
    order = [("missing:", "fill_missing"), ("duplicate:", "remove_duplicate"), ("outlier:", "remove_outlier"),
             ("category:", "fix_category"), ("formatting:", "fix_formatting")]
    out = None
    for prefix, action in order:
        hit = any_issue(issues, prefix=prefix)
        out = F.when(hit, F.lit(action)) if out is None else out.when(hit, F.lit(action))
    return out.otherwise(F.lit("skip"))


def can_handle(agent: str, issues: Column) -> Column:
    if agent == "FillMissingAgent":
        return any_issue(issues, prefix="missing:")
    if agent == "DuplicateDetector":
        return any_issue(issues, part="duplicate")
    if agent == "OutlierHandler":
        return any_issue(issues, part="outlier")
    if agent == "CategoryStandardizer":
        return any_issue(issues, part="category") | any_issue(issues, part="formatting")
    if agent == "SkipAgent":
        return F.lit(True)
    raise ValueError(f"unknown agent: {agent}")


def responsible_agent(issues: Column) -> Column:
    low = F.transform(issues, F.lower)
    return (
        F.when(any_issue(low, part="missing"), F.lit("FillMissingAgent"))
        .when(any_issue(low, part="duplicate"), F.lit("DuplicateDetector"))
        .when(any_issue(low, part="outlier"), F.lit("OutlierHandler"))
        .when(any_issue(low, part="category") | any_issue(low, part="format"), F.lit("CategoryStandardizer"))
        .otherwise(F.lit("SkipAgent"))
    )


def rows_with_issue(df: DataFrame, column: str, issues: str = "issues") -> DataFrame:
    return df.filter(F.exists(F.col(issues), lambda x: F.lower(x).contains(column.lower())))


def issue_counts(df: DataFrame, issues: str = "issues") -> DataFrame:
    return explode_issues(df, issues).groupBy("kind", "column").agg(F.count(F.lit(1)).alias("n"))
