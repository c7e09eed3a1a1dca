"""One action per row: specialists propose, a scored choice decides. All column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions.scalars import any_issue, clamp, count_issues, first_issue_column, fixed_length
from tidemark.functions.similarity import ratio_udf
from tidemark.operators.clean import category_lookup, email_with_known_domain, fuzzy_category
from tidemark.operators.detect import can_handle

ACTION_TYPE = "struct<action_type:string,column:string,value:string>"


@dataclass(frozen=True)
class Specialist:
    """A pluggable decision maker.

    ``proposal`` is a struct (action_type, column, value), NULL for no proposal; ``expertise`` lists the
    issue texts it is good at.
    """

    name: str
    proposal: Column
    confidence: Column
    applies: Column
    expertise: Sequence[str] = ()


def _proposal(action: str, column, value) -> Column:
    column = column if isinstance(column, Column) else F.lit(column)
    value = value.cast("string") if isinstance(value, Column) else F.lit(None if value is None else str(value))
    return F.struct(F.lit(action).alias("action_type"), column.alias("column"), value.cast("string").alias("value"))


def _allowed(legal: Column | None, action: str) -> Column:
    return F.lit(True) if legal is None else F.array_contains(legal, action)


def fill_specialist(df: DataFrame, issues: Column, legal: Column | None = None) -> Specialist:
    column = first_issue_column(issues, "missing")
    values = F.create_map(*[F.lit(str(x)) for kv in vocab.FILL_DEFAULTS.items() for x in kv])
    sure = F.create_map(*[F.lit(x) for kv in vocab.FILL_CONFIDENCE.items() for x in kv])
    usable = _allowed(legal, "fill_missing") & column.isin(df.columns)
    return Specialist(
        "FillMissingAgent",
        F.when(usable, _proposal("fill_missing", column, values[column])),
        F.coalesce(sure[column], F.lit(vocab.FILL_CONFIDENCE_OTHER)),
        can_handle("FillMissingAgent", issues),
        ("missing:",),
    )


def duplicate_specialist(df: DataFrame, issues: Column, legal: Column | None = None,
                         similarity: Column | None = None, threshold: float = 0.7, first: str = "id") -> Specialist:
    """``similarity`` to earlier rows; rows flagged as duplicates count as equal where it is not given."""
    similarity = F.lit(1.0) if similarity is None else similarity
    flagged = any_issue(issues, part="duplicate") & _allowed(legal, "remove_duplicate")
    return Specialist(
        "DuplicateDetector",
        F.when(flagged & (similarity >= threshold), _proposal("remove_duplicate", first, None)),
        similarity,
        can_handle("DuplicateDetector", issues),
        ("duplicate",),
    )


def outlier_specialist(df: DataFrame, issues: Column, legal: Column | None = None) -> Specialist:
    flagged = any_issue(issues, part="outlier") & _allowed(legal, "remove_outlier")
    proposal, confidence = None, None
    for c, (q1, q3) in vocab.TYPICAL_QUARTILES.items():
        if c not in df.columns or isinstance(df.schema[c].dataType, T.StringType):
            continue
        hit = flagged & P.outlier_fixed(F.col(c), q1, q3)
        p = _proposal("remove_outlier", c, vocab.TYPICAL_MEDIANS[c])
        conf = P.outlier_confidence(F.col(c), c)
        proposal = F.when(hit, p) if proposal is None else proposal.when(hit, p)
        confidence = F.when(hit, conf) if confidence is None else confidence.when(hit, conf)
    if proposal is None:
        proposal, confidence = F.lit(None).cast(ACTION_TYPE), F.lit(0.0)
    return Specialist("OutlierHandler", proposal, F.coalesce(confidence, F.lit(0.0)),
                      can_handle("OutlierHandler", issues), ("outlier",))


def category_specialist(df: DataFrame, issues: Column, legal: Column | None = None, fuzzy: bool = True,
                        columns: Sequence[str] = ("dept",)) -> Specialist:
    """Closest known value of the first category column that differs from it. Names and addresses are no categories: they are
    looked at only where ``columns`` asks for it, and of an e-mail the domain alone is matched.

    With ``fuzzy=False`` only the literal category map is consulted (confidence 1), which needs no Python.
    """
    flagged = (any_issue(issues, part="category") | any_issue(issues, part="formatting")) & _allowed(legal, "fix_category")
    proposal, confidence = None, None
    for c in columns:
        if c not in df.columns:
            continue
        text = F.when(flagged, F.col(c))
        if fuzzy and c == "email":
            fixed = email_with_known_domain(text)
        else:
            fixed = fuzzy_category(text, vocab.KNOWN_CATEGORIES[c]) if fuzzy else category_lookup(text)
        hit = flagged & F.coalesce(fixed != F.col(c), F.lit(False))
        conf = ratio_udf(lower_first=True)(F.when(hit, F.col(c)), F.when(hit, fixed)) if fuzzy else F.lit(1.0)
        p = _proposal("fix_category", c, fixed)
        proposal = F.when(hit, p) if proposal is None else proposal.when(hit, p)
        confidence = F.when(hit, conf) if confidence is None else confidence.when(hit, conf)
    if proposal is None:
        proposal, confidence = F.lit(None).cast(ACTION_TYPE), F.lit(0.0)
    return Specialist("CategoryStandardizer", proposal, F.coalesce(confidence, F.lit(0.0)),
                      can_handle("CategoryStandardizer", issues), ("category", "formatting"))


def skip_specialist(first: str = "id") -> Specialist:
    return Specialist("SkipAgent", _proposal("skip", first, None), F.lit(0.2), F.lit(True))


SPECIALISTS = {
    "FillMissingAgent": fill_specialist,
    "DuplicateDetector": duplicate_specialist,
    "OutlierHandler": outlier_specialist,
    "CategoryStandardizer": category_specialist,
    "SkipAgent": lambda df, issues, legal=None: skip_specialist(),
}


def specialist(name: str, df: DataFrame, issues: Column, **kw) -> Specialist:
    if name not in SPECIALISTS:
        raise ValueError(f"unknown agent: {name}")
    return SPECIALISTS[name](df, issues, **kw)


def default_specialists(df: DataFrame, issues: Column, legal: Column | None = None, fuzzy: bool = True,
                        similarity: Column | None = None, first: str = "id") -> list[Specialist]:
    return [
        fill_specialist(df, issues, legal),
        duplicate_specialist(df, issues, legal, similarity, first=first),
        outlier_specialist(df, issues, legal),
        category_specialist(df, issues, legal, fuzzy),
        skip_specialist(first),
    ]


def expertise_bonus(issues: Column, expertise: Sequence[str]) -> Column:
    """0 without a matching issue, else .3 and .2 per matching issue, at most 1."""
    if not expertise:
        return F.lit(0.0)

    n = count_issues(issues, *expertise)
    return F.when(n > 0, F.least(F.lit(1.0), 0.3 + n * 0.2)).otherwise(F.lit(0.0))


def recommend(df: DataFrame, specialists: Sequence[Specialist], issues: str = "issues",
              name: str = "candidates") -> DataFrame:
    """Array of (agent, pos, action_type, column, value, confidence, expertise), one per proposing specialist."""
    entries = []
    for pos, s in enumerate(specialists):
        entry = F.struct(
            F.lit(s.name).alias("agent"), F.lit(pos).alias("pos"),
            s.proposal["action_type"].alias("action_type"), s.proposal["column"].alias("column"),
            s.proposal["value"].alias("value"), s.confidence.cast("double").alias("confidence"),
            expertise_bonus(F.col(issues), s.expertise).alias("expertise"),
        )
        entries.append(F.coalesce(F.when(s.applies & s.proposal.isNotNull(), F.array(entry)), F.array()))
    return df.withColumn(name, F.concat(*entries))


def history_snapshot(history: DataFrame) -> Column:
    """Scalar map agent -> mean reward of its last rewards, from a table (agent, reward_avg)."""
    known = history.filter(F.col("agent").isin(vocab.AGENTS)).groupBy("agent").agg(F.avg("reward_avg").alias("a"))
    return known.agg(F.map_from_entries(F.collect_list(F.struct("agent", "a")))).scalar()


def choose_action(df: DataFrame, candidates: str = "candidates", history: DataFrame | None = None) -> DataFrame:
    """Add ``decision`` (agent, action_type, column, value, confidence, score): the highest score, earlier
    specialists first on ties. Without ``history`` every agent has the neutral record."""
    src = df
    if history is not None:
        src = df.withColumn("__history", history_snapshot(history))

    def record(agent: Column) -> Column:
        avg = F.coalesce(F.col("__history")[agent], F.lit(0.0)) if history is not None else F.lit(0.0)
        return clamp(avg + 0.5)

    scored = F.transform(candidates, lambda x: F.struct(
        (-(0.4 * x["confidence"] + 0.3 * record(x["agent"]) + 0.3 * x["expertise"])).alias("order"),
        x["pos"].alias("pos"), x["agent"].alias("agent"), x["action_type"].alias("action_type"),
        x["column"].alias("column"), x["value"].alias("value"), x["confidence"].alias("confidence")))
    best = F.array_min(scored)
    out = src.withColumn("__best", best).withColumn("decision", F.struct(
        *[F.col(f"__best.{f}") for f in ("agent", "action_type", "column", "value", "confidence")],
        (-F.col("__best.order")).alias("score")))
    return out.drop("__best", "__history")


def rule_action(df: DataFrame, issues: str = "issues", legal: str = "legal", first: str = "id") -> DataFrame:
    """Deterministic policy: the first rule whose issue is present and whose action is legal, else skip."""
    # fixed values: issue, action, column, value - in order of precedence
    rules = [
        ("missing:age", "fill_missing", "age", "30"),
        ("missing:salary", "fill_missing", "salary", "60000"),
        ("missing:score", "fill_missing", "score", "80"),
        ("missing:name", "fill_missing", "name", "unknown"),
        ("wrong_type:score", "fix_type", "score", None),
        ("formatting:email", "fix_formatting", "email", None),
        ("formatting:name", "fix_formatting", "name", None),
        ("formatting:dept", "fix_category", "dept", None),
    ]
    out = None
    for issue, action, column, value in rules:
        hit = F.array_contains(issues, issue) & F.array_contains(legal, action)
        p = _proposal(action, column, value)
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return df.withColumn("action", out.otherwise(_proposal("skip", first, None)))


def sanitize_actions(df: DataFrame, columns: Sequence[str], action: str = "action") -> DataFrame:
    """Unknown or absent columns become the first column; an absent action becomes skip."""
    a = F.col(action)
    column = F.when(a["column"].isin(list(columns)), a["column"]).otherwise(F.lit(columns[0]))
    return df.withColumn(action, F.struct(
        F.coalesce(a["action_type"], F.lit("skip")).alias("action_type"), column.alias("column"),
        a["value"].alias("value")))


def encode_observation(df: DataFrame, issues: str = "issues", legal: str | None = "legal",
                       name: str = "state", size: int = vocab.STATE_SIZE) -> DataFrame:
    """Fixed-length vector: numbers, presence of texts, issue flags, legal-action flags, zero padding."""
    parts = []
    for c in vocab.OBSERVED_NUMERIC:
        if c not in df.columns:
            parts.append(F.lit(0.0))
        elif isinstance(df.schema[c].dataType, T.StringType):
            parts.append(F.coalesce(P.parse_number(F.col(c)), F.lit(0.0)))
        else:
            parts.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    for c in vocab.OBSERVED_TEXT:
        parts.append(F.coalesce((F.col(c) != "").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    parts += [F.array_contains(issues, i).cast("double") for i in vocab.OBSERVED_ISSUES]
    parts += [F.array_contains(legal, a).cast("double") if legal else F.lit(1.0) for a in vocab.ACTIONS]
    return df.withColumn(name, fixed_length(F.array(*parts), size))


def masked_argmax(scores: Column, legal: Column, actions: Sequence[str] = vocab.ACTIONS) -> Column:
    """Struct (action, confidence): best-scored legal action; skip with confidence 0 where none is legal."""
    names = F.array(*[F.lit(a) for a in actions])
    open_ = F.filter(
        F.transform(F.slice(scores, 1, len(actions)),
                    lambda q, i: F.struct((-q.cast("double")).alias("order"), i.alias("i"),
                                          F.get(names, i).alias("action"))),
        lambda x: F.array_contains(legal, x["action"]))
    best = F.array_min(open_)
    confidence = F.least(F.lit(1.0), F.array_max(scores).cast("double") / 10.0)
    return F.when(F.size(open_) > 0, F.struct(best["action"].alias("action"), confidence.alias("confidence"))).otherwise(
        F.struct(F.lit("skip").alias("action"), F.lit(0.0).alias("confidence")))


def policy_action(scores: Column, legal: Column, actions: Sequence[str] = vocab.ACTIONS) -> Column:
    """The policy's choice as an action: struct (action_type, column, value, confidence)."""
    best = masked_argmax(scores, legal, actions)
    columns = F.create_map(*[F.lit(x) for a, (c, _) in vocab.POLICY_TARGETS.items() for x in (a, c)])
    values = F.create_map(*[F.lit(x) for a, (_, v) in vocab.POLICY_TARGETS.items() if v is not None for x in (a, v)])
    action = best["action"]
    return F.struct(action.alias("action_type"), F.coalesce(columns[action], F.lit("id")).alias("column"), values[action].alias("value"),
                    best["confidence"].alias("confidence"))


def route(confidence: Column, high: float = 0.8) -> Column:
    """Confident rows go to the learned policy, the rest to the rules."""
    return F.when(confidence > high, F.lit("policy")).otherwise(F.lit("rules"))
