"""Applying one decided action per row, and the change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.operators.clean import category_lookup, fix_formatting, fix_type_cell
from tidemark.operators.rewards import step_reward
from tidemark.operators.segments import null_safe


def apply_actions(df: DataFrame, actions: DataFrame, keys: Sequence[str] = ("name", "email"),
                  row_id: str = "row_id") -> DataFrame:
    """Carry out (row_id, action_type, column, value) on the rows; rows without an action are skipped."""
    act = actions.select(F.col(row_id).alias("__rid"), F.struct("action_type", "column", "value").alias("__action"))
    j = df.join(act, df[row_id] == act["__rid"], "left").drop("__rid")
    return apply_decisions(j, "__action", df.columns, keys, row_id)


def apply_decisions(df: DataFrame, action: str, columns: Sequence[str], keys: Sequence[str] = ("name", "email"),
                    row_id: str = "row_id", carry: Sequence[str] = (), proposed: bool = False, mode: str = "na") -> DataFrame:
    """Carry out the action (struct action_type, column, value) that stands beside each row.

    Gives the columns with action_type, column, old_value, new_value, took_effect, removed and reward, and
    the ``carry`` columns as they are. A row whose action is remove_duplicate goes if an earlier row, after
    its own action, has the same keys. Only those rows meet the key table, which holds one pre-aggregated
    row per key; decisions made on the same frame need no join at all.

    By default categories and outliers are repaired by the fixed rule, whatever value stands in the action. With
    ``proposed`` the action's value is written: a category where it differs, an outlier where the cell is one by the
    specialist's own test. ``mode`` tells what a fill takes for missing.
    """
    j = df.withColumns({
        "__act": F.coalesce(F.col(f"{action}.action_type"), F.lit("skip")),
        "__col": F.col(f"{action}.column"), "__val": F.col(f"{action}.value")})
    new, effects, old_text, new_text = {}, F.lit(False), None, None
    for f in df.select(*columns).schema.fields:
        if f.name == row_id:
            continue
        c = F.col(f.name)
        here = F.coalesce(F.col("__col") == f.name, F.lit(False))
        is_text = isinstance(f.dataType, T.StringType)
        is_number = isinstance(f.dataType, T.NumericType)
        steps = [(here & (F.col("__act") == "fill_missing") & P.missing(c, mode, f.dataType),
                  F.col("__val").try_cast(f.dataType.simpleString()))]
        if is_text:
            steps.append((here & (F.col("__act") == "fix_type") & P.numeric_text(c), fix_type_cell(c)))
            if proposed:
                steps.append((here & (F.col("__act") == "fix_category") & F.coalesce(F.col("__val") != c, F.lit(False)), F.col("__val")))
            steps.append((here & (F.col("__act") == "fix_category") & category_lookup(c).isNotNull(), category_lookup(c)))
            steps.append((here & (F.col("__act") == "fix_formatting") & c.isNotNull(), fix_formatting(c)))
        if is_number:
            steps.append((here & (F.col("__act") == "fix_type") & c.isNotNull(), c))
            if proposed and f.name in vocab.TYPICAL_QUARTILES:
                value_of = F.col("__val").try_cast(f.dataType.simpleString())
                steps.append((here & (F.col("__act") == "remove_outlier") & value_of.isNotNull()
                              & P.outlier_fixed(c, *vocab.TYPICAL_QUARTILES[f.name]), value_of))
            bare = F.col("__val").isNull() if proposed else F.lit(True)
            steps.append((here & (F.col("__act") == "remove_outlier") & bare & P.outlier_range(c),
                          F.lit(vocab.RANGE_REPLACEMENT).cast(f.dataType)))
        value = None
        for cond, result in steps:
            value = F.when(cond, result) if value is None else value.when(cond, result)
            effects = effects | cond
        new[f.name] = value.otherwise(c)
        old_text = F.when(here, c.cast("string")) if old_text is None else old_text.when(here, c.cast("string"))
        n = new[f.name].cast("string")
        new_text = F.when(here, n) if new_text is None else new_text.when(here, n)
    done = j.select(
        row_id, *[v.alias(n) for n, v in new.items()], *carry,
        *[F.col(k).alias(f"__raw_{k}") for k in keys],
        F.col("__act").alias("action_type"), F.col("__col").alias("column"),
        old_text.alias("old_value"), new_text.alias("new_value"), effects.alias("took_effect"))
    firsts = done.groupBy(*keys).agg(F.min(row_id).alias("__first"))
    askers = done.filter(F.col("action_type") == "remove_duplicate").select(
        F.col(row_id).alias("__gone"), *[F.col(f"__raw_{k}").alias(k) for k in keys])
    gone = null_safe(askers, firsts, keys, "inner").filter(F.col("__first") < F.col("__gone")).select("__gone")
    out = done.join(gone, done[row_id] == gone["__gone"], "left")
    removed = F.col("__gone").isNotNull()
    effect = F.when(F.col("action_type") == "remove_duplicate", removed).otherwise(F.col("took_effect"))
    return out.select(
        *columns, *carry, "action_type", "column", "old_value", "new_value", effect.alias("took_effect"),
        removed.alias("removed"), step_reward(F.col("action_type"), effect).alias("reward"))


def cleaned_rows(applied: DataFrame, columns: Sequence[str]) -> DataFrame:
    return applied.filter(~F.col("removed")).select(*columns)


def diff(before: DataFrame, after: DataFrame, row_id: str = "row_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Long table of changed cells: row_id, column, old_value, new_value."""
    columns = [c for c in before.columns if c != row_id and c in after.columns] if columns is None else list(columns)
    b = before.select(row_id, *[F.col(c).alias(f"__b_{c}") for c in columns])
    a = after.select(row_id, *[F.col(c).alias(f"__a_{c}") for c in columns])
    cells = [
        F.when(~F.col(f"__b_{c}").eqNullSafe(F.col(f"__a_{c}")), F.struct(
            F.lit(c).alias("column"), F.col(f"__b_{c}").cast("string").alias("old_value"),
            F.col(f"__a_{c}").cast("string").alias("new_value")))
        for c in columns
    ]
    long = b.join(a, row_id).select(row_id, F.explode(F.array(*cells)).alias("x"))
    return long.filter(F.col("x").isNotNull()).select(row_id, "x.*")
