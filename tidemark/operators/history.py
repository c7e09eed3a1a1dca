"""Ordered history: running values, recent means, pairs of steps, newest rows.

Groups here are agents, episodes and runs - few and large - so ordered work goes through
``segments`` and nothing sorts a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import vocab
from tidemark.operators.segments import DEFAULT_WIDTH, apart, null_safe, over_rows, with_rank, with_running


def rolling_avg(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 10,
                width: int = DEFAULT_WIDTH, name: str = "rolling_avg") -> DataFrame:
    """Mean of the last n values, only where there are n."""
    def mean(w):
        return F.when(F.col("__rank") >= n, F.avg(value).over(w.rowsBetween(-(n - 1), 0)))

    return over_rows(df, keys, order, {name: mean}, back=n - 1, width=width, rank="__rank")


def recent_agent_reward(df: DataFrame, agent: str = "agent", order: str = "row_id", reward: str = "reward",
                        n: int = vocab.HISTORY_LENGTH, width: int = DEFAULT_WIDTH, name: str = "recent_reward") -> DataFrame:
    """Mean reward of the agent's previous n decisions (NULL before the first)."""
    return over_rows(df, [agent], order, {name: lambda w: F.avg(reward).over(w.rowsBetween(-n, -1))}, back=n, width=width, rank="__rank")


def last_rewards(df: DataFrame, agent: str = "agent", order: str = "row_id", reward: str = "reward",
                 n: int = vocab.HISTORY_LENGTH) -> DataFrame:
    """agent, reward_avg, kept over the newest n rewards of each agent; only n rows per agent and task are exchanged."""
    newest = F.row_number().over(Window.partitionBy(agent).orderBy(F.col(order).desc()))
    kept = df.select(agent, order, reward).withColumn("__r", newest).filter(F.col("__r") <= n)
    return kept.groupBy(agent).agg(F.avg(reward).alias("reward_avg"), F.count(F.lit(1)).alias("kept"))


def progress(df: DataFrame, keys: Sequence[str], order: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add row_index (from 0) and progress (row_index / total, 2 decimals)."""
    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        return d.withColumns({"__rank": F.row_number().over(w.orderBy(order)).cast("bigint"), "total_rows": F.count(F.lit(1)).over(w)})

    def pieced(d: DataFrame) -> DataFrame:
        return null_safe(with_rank(d, keys, order, width, "__rank"), d.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows")), keys, "inner")

    return apart(df, keys, width, plain, pieced).withColumns({
        "row_index": F.col("__rank") - 1,
        "progress": F.round((F.col("__rank") - 1) / F.col("total_rows"), 2),
    }).drop("__rank")


def job_progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(0.0))


def to_transitions(df: DataFrame, episode: str = "episode", step: str = "step", state: str = "state",
                   width: int = DEFAULT_WIDTH) -> DataFrame:
    """Pair every row with the next of its episode; the last is done and repeats its own state.

    ``step`` is the dense 1-based position in the episode.
    """
    def following(w):
        return F.lead(F.struct(F.col(state).alias("s"))).over(w)

    d = over_rows(df, [episode], step, {"__next": following}, ahead=1, width=width)
    return d.withColumns({
        "next_state": F.coalesce(F.col("__next.s"), F.col(state)),
        "done": F.col("__next").isNull(),
    }).drop("__next")


def cumulative_reward(df: DataFrame, keys: Sequence[str], order: str, reward: str = "reward",
                      width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add total_reward and step_count so far."""
    return with_running(df, keys, order, {"total_reward": F.col(reward), "step_count": F.lit(1).cast("bigint")}, width)


def sequence_number(df: DataFrame, keys: Sequence[str], order: str, width: int = DEFAULT_WIDTH,
                    name: str = "sequence") -> DataFrame:
    return with_rank(df, keys, order, width, name)


def buffer_last(df: DataFrame, capacity: int, order: str = "row_id") -> DataFrame:
    """The newest ``capacity`` rows."""
    return df.orderBy(F.col(order).desc()).limit(capacity)


def top_n_per_group(df: DataFrame, group: str, by: str, tie: str, n: int = 5) -> DataFrame:
    """The n best rows per group; the rank filter runs before the exchange as well."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).withColumnRenamed("__r", "place")


def latest_run(df: DataFrame, stamp: str) -> DataFrame:
    """The rows of the newest result set."""
    return df.filter(F.col(stamp) == df.agg(F.max(stamp)).scalar())


def latest_per_key(df: DataFrame, keys: Sequence[str], stamp: str, tie: str) -> DataFrame:
    """The newest row of each key, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(stamp).alias("__s"), F.col(tie).alias("__t"),
                                                F.struct(*rest).alias("__v")))["__v"].alias("__v"))
    return best.select(*keys, "__v.*")
