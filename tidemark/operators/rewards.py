"""Rewards per decision."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import vocab
from tidemark.functions.scalars import any_issue, clamp, count_issues
from tidemark.operators.segments import DEFAULT_WIDTH, null_safe, over_rows, spread
from tidemark.session import cut


def batch_reward(action: Column, issues: Column) -> Column:
    """Skip: small loss with issues, small gain without; other actions gain with the issues, three at most."""
    n = F.size(issues)
    return F.when(action == "skip", F.when(n > 0, F.lit(-0.05)).otherwise(F.lit(0.05))).otherwise(
        0.2 + 0.05 * F.least(n, F.lit(3)))


def step_reward(action: Column, took_effect: Column) -> Column:
    out = None
    for name, (good, bad) in vocab.STEP_REWARDS.items():
        r = F.when(took_effect, F.lit(good)).otherwise(F.lit(bad))
        out = F.when(action == name, r) if out is None else out.when(action == name, r)
    return out.otherwise(F.lit(vocab.STEP_REWARD_UNKNOWN))


def base_reward(action: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in vocab.BASE_REWARDS.items() for x in kv])[action], F.lit(0.0))


def issue_adjustment(action: Column, issues: Column) -> Column:
    """A bonus per issue the action addresses."""
    def n(*parts: str) -> Column:
        return count_issues(issues, *parts)

    return (
        F.when(action == "fill_missing", 0.1 * n("missing:"))
        .when(action == "remove_duplicate", 0.1 * n("duplicate"))
        .when(action == "remove_outlier", 0.1 * n("outlier"))
        .when(action == "fix_category", 0.05 * n("category", "formatting"))
        .when(action == "fix_type", 0.05 * n("type"))
        .otherwise(F.lit(0.0))
    )


def skip_bonus(action: Column, issues: Column) -> Column:
    major = (any_issue(issues, prefix="missing:") | any_issue(issues, prefix="duplicate")
             | any_issue(issues, prefix="outlier"))
    return F.when((action == "skip") & ~major, F.lit(0.1)).otherwise(F.lit(0.0))


def completion_bonus(score: Column) -> Column:
    out = None
    for bound, bonus in vocab.COMPLETION_BONUS:
        out = F.when(score >= bound, F.lit(bonus)) if out is None else out.when(score >= bound, F.lit(bonus))
    return out.otherwise(F.lit(0.0))


def progress_bonus(step: Column, total: Column) -> Column:
    """0.05 for every fifth of the episode behind."""
    return F.when(total > 0, F.floor(step / total * 5) * 0.05).otherwise(F.lit(0.0))


def with_total_steps(decisions: DataFrame, episode: str = "episode", name: str = "total_steps") -> DataFrame:
    totals = decisions.groupBy(episode).agg(F.count(F.lit(1)).alias(name))
    return null_safe(decisions, totals, [episode], "inner")


def with_contradiction(decisions: DataFrame, episode: str = "episode", step: str = "step",
                       width: int = DEFAULT_WIDTH, name: str = "contradiction") -> DataFrame:
    """-0.2 where one of the last few actions did something else than skip, and else than this action, to the column."""
    back = vocab.CONTRADICTION_LOOKBACK

    def clash(w):
        recent = F.collect_list(F.struct("action_type", "column")).over(w.rowsBetween(-back, -1))
        hit = F.exists(recent, lambda x: x["column"].eqNullSafe(F.col("column"))
                       & (x["action_type"] != F.col("action_type")) & (x["action_type"] != "skip"))
        return F.when(hit, F.lit(-0.2)).otherwise(F.lit(0.0))

    return over_rows(decisions, [episode], step, {name: clash}, back=back, width=width)


def _consistency(share: Column) -> Column:
    return F.when(share >= 0.8, F.lit(0.1)).when(share >= 0.6, F.lit(0.05)).otherwise(F.lit(0.0))


def with_consistency(decisions: DataFrame, positive: Column, episode: str = "episode", step: str = "step",
                     width: int = DEFAULT_WIDTH, name: str = "consistency") -> DataFrame:
    """Bonus by the share of successes among the same action in the last 100 steps."""
    back = vocab.HISTORY_LENGTH

    def share(w):
        return _consistency(F.avg(positive.cast("int")).over(w.rangeBetween(-back, -1)))

    return over_rows(decisions, [episode], step, {name: share}, back=back, width=width, also=["action_type"])


def _total(consistency: Column) -> Column:
    # summed in this order: the sign of a reward near zero depends on it
    return F.col("__before") + consistency + F.col("contradiction") + F.col("__issue") + F.col("__skip")


def settle_signs(rows: DataFrame, width: int) -> DataFrame:
    """Find the sign of rewards that depend on the signs of up to 100 earlier rewards of the same action.

    The rule is monotone (more successes before never make a success less likely), so it is run from both
    ends: ``lo`` and ``hi`` bound every sign. Each round folds all pieces of an episode at once, with the
    last known bounds of the rows before the piece; a sign is settled when the bounds meet. The first open
    piece of an episode settles in every round, most pieces in the first: no task ever holds more than
    ``width`` rows and the history in front of them.
    """
    work = cut(rows, "signs")
    names, schema, lookback = work.columns, work.schema, vocab.HISTORY_LENGTH
    keys = ["episode", "action_type", "__piece"]

    def fold_piece(piece: dict[str, list]) -> tuple[list[bool], list[bool]]:
        recent: deque = deque()
        n_lo = n_hi = 0
        lows, highs = [], []
        for step, before, clash, issue, skip, lo, hi, guest in zip(*piece.values()):
            while recent and recent[0][0] < step - lookback:
                _, was_lo, was_hi = recent.popleft()
                n_lo, n_hi = n_lo - was_lo, n_hi - was_hi
            if lo != hi and not guest:
                signs = []
                for successes in (n_lo, n_hi):
                    share = successes / len(recent) if recent else 0.0
                    bonus = 0.1 if share >= 0.8 else 0.05 if share >= 0.6 else 0.0
                    signs.append(before + bonus + clash + issue + skip > 0)
                lo, hi = signs
            lows.append(lo)
            highs.append(hi)
            recent.append((step, lo, hi))
            n_lo, n_hi = n_lo + lo, n_hi + hi
        return lows, highs

    def fold(batches):
        """Pieces arrive whole and in order; a piece is folded once its last row is in, so a task keeps one."""
        cols = ["step", "__before", "contradiction", "__issue", "__skip", "__lo", "__hi", "__guest"]
        held: list[pd.DataFrame] = []

        def fold_all(pdf: pd.DataFrame) -> pd.DataFrame:
            lows, highs = [], []
            for _, part in pdf.groupby(keys, sort=False, dropna=False):
                lo, hi = fold_piece({c: part[c].tolist() for c in cols})
                lows += lo
                highs += hi
            out = pdf.assign(__lo=lows, __hi=highs)
            return out.loc[~out["__guest"], names]

        for pdf in batches:
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            last = pdf[keys].iloc[-1] if len(pdf) else None
            if last is None:
                continue
            same = True
            for k in keys:
                same = same & ((pdf[k] == last[k]) | (pdf[k].isna() & pd.isna(last[k])))
            held = [pdf[same]]
            if not same.all():
                yield fold_all(pdf[~same].reset_index(drop=True))
        if held:
            yield fold_all(held[0].reset_index(drop=True))

    while not work.filter(F.col("__lo") != F.col("__hi")).isEmpty():
        pieces = spread(work, "step", lookback, 0, min(width, PIECE))
        ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, "step")
        work = cut(ordered.mapInPandas(fold, schema), "signs")
    return work


# rows of one episode and action that a task holds in memory at once
PIECE = 200_000

MADE = ("total_steps", "contradiction", "consistency", "reward")


def shaped_reward(decisions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add ``reward``: base, progress, consistency, contradiction, issue and skip terms, clamped to +-1.

    Input: episode, step (1, 2, ...), action_type, column, issues. The six repairs always earn more than
    nothing, so their record is spotless and needs no history of rewards; for skip and unknown actions the
    signs are settled first (:func:`settle_signs`).
    """
    kept = [c for c in decisions.columns if c not in MADE]
    decisions = decisions.select(*kept)
    action, issues = F.col("action_type"), F.col("issues")
    d = with_contradiction(with_total_steps(decisions), width=width).withColumns({
        "__before": base_reward(action) + progress_bonus(F.col("step"), F.col("total_steps")),
        "__issue": issue_adjustment(action, issues),
        "__skip": skip_bonus(action, issues),
    })
    d = cut(d, "terms")  # read by both branches below
    repairs = [a for a in vocab.BASE_REWARDS if a != "skip"]
    closed = d.filter(action.isin(repairs)).withColumn("__positive", F.lit(True))
    open_rows = d.filter(~F.coalesce(action.isin(repairs), F.lit(False))).withColumns({
        "__lo": _total(F.lit(0.0)) > 0, "__hi": _total(F.lit(0.1)) > 0})
    settled = settle_signs(open_rows, width).withColumn("__positive", F.col("__lo")).drop("__lo", "__hi")
    scored = with_consistency(closed.unionByName(settled), F.col("__positive"), width=width)
    return scored.select(*kept, "total_steps", "contradiction", "consistency",
                         clamp(_total(F.col("consistency")), -1.0, 1.0).alias("reward"))


def repair_rewards(decisions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """:func:`shaped_reward` for the rows whose action is one of the six repairs - one lazy plan."""
    kept = [c for c in decisions.columns if c not in MADE]
    decisions = decisions.select(*kept)
    action, issues = F.col("action_type"), F.col("issues")
    d = with_contradiction(with_total_steps(decisions), width=width)
    d = with_consistency(d, F.lit(True), width=width)
    total = (base_reward(action) + progress_bonus(F.col("step"), F.col("total_steps")) + F.col("consistency")
             + F.col("contradiction") + issue_adjustment(action, issues))
    return d.filter(action.isin([a for a in vocab.BASE_REWARDS if a != "skip"])).select(
        *kept, "total_steps", "contradiction", "consistency", clamp(total, -1.0, 1.0).alias("reward"))
