"""Reports over decisions, rewards, jobs, runs and benchmark results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import vocab


def agent_stats(decisions: DataFrame) -> DataFrame:
    """Per agent: usage, share of all, mean reward, success rate; every agent appears."""
    spark = decisions.sparkSession
    roster = spark.createDataFrame([(a,) for a in vocab.AGENTS], "agent string")
    g = decisions.filter(F.col("agent").isin(vocab.AGENTS)).groupBy("agent").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("avg"), F.avg((F.col("reward") > 0).cast("int")).alias("ok"))
    return roster.join(g, "agent", "left").select(
        "agent", F.coalesce("n", F.lit(0)).alias("usage_count"), F.coalesce("avg", F.lit(0.0)).alias("average_reward"),
        F.coalesce("ok", F.lit(0.0)).alias("success_rate"))


def episode_summary(decisions: DataFrame) -> DataFrame:
    """Per episode: steps, uses per agent (map), mean confidence."""
    per = decisions.groupBy("episode", "agent").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    return per.groupBy("episode").agg(
        F.sum("n").alias("total_steps"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "n")))).alias("agent_usage"),
        (F.sum("c") / F.sum("n")).alias("average_confidence"))


def reward_stats(rewards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    r = F.col("reward")
    return rewards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_actions"), F.avg(r).alias("average_reward"), F.max(r).alias("max_reward"),
        F.min(r).alias("min_reward"), F.count_if(r > 0).alias("positive_actions"),
        F.count_if(r < 0).alias("negative_actions"))


def reward_by_action(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("action_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("average_reward"), F.sum("reward").alias("total_reward"))


def action_counts(decisions: DataFrame, totals: bool = False) -> DataFrame:
    """Counts by action and agent; with ``totals`` also the subtotals and the grand total."""
    keys = ["action_type", "agent"]
    g = decisions.rollup(*keys) if totals else decisions.groupBy(*keys)
    return g.agg(F.count(F.lit(1)).alias("n"))


def duration_histogram(df: DataFrame, c: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bucket counts: by, le, n - the last bucket (+Inf) holds all that have a value; a group without any has zeros."""
    aggs = [F.count_if(F.col(c) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    flat = df.groupBy(*by).agg(*aggs, F.count(c).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return flat.select(*by, F.inline(F.array(*rows)))


def transition_stats(df: DataFrame, capacity: int) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) / capacity).alias("utilization"),
        F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"),
        F.min("reward").alias("reward_min"), F.max("reward").alias("reward_max"),
        F.avg(F.col("done").cast("int")).alias("done_rate"),
        F.avg("priority").alias("priority_mean"), F.stddev_pop("priority").alias("priority_std"),
        F.min("priority").alias("priority_min"), F.max("priority").alias("priority_max"))


def run_report(rewards: DataFrame, run: str, order: str, reward: str = "reward", epsilon: str = "epsilon",
               n: int = 10) -> DataFrame:
    """Per run: mean and deviation of the last n rewards, best, worst, last epsilon."""
    newest = F.row_number().over(Window.partitionBy(run).orderBy(F.col(order).desc()))
    last = rewards.select(run, order, reward).withColumn("__r", newest).filter(F.col("__r") <= n).groupBy(run).agg(
        F.avg(reward).alias("final_avg_reward"), F.stddev_pop(reward).alias("final_std_reward"))
    whole = rewards.groupBy(run).agg(
        F.max(reward).alias("best_reward"), F.min(reward).alias("worst_reward"),
        F.max_by(epsilon, order).alias("final_epsilon"), F.count(F.lit(1)).alias("total_transitions"))
    return whole.join(last, run)


def evaluation_report(episodes: DataFrame) -> DataFrame:
    """From one row per episode (total_reward, steps)."""
    return episodes.agg(F.avg("total_reward").alias("avg_reward"), F.avg("steps").alias("avg_steps"),
                        F.avg((F.col("total_reward") > 0).cast("int")).alias("success_rate"))


def decision_accuracy(decisions: DataFrame, episode: str = "episode", chosen: str = "action_type",
                      expected: str = "expected") -> DataFrame:
    """Per episode: decisions, correct ones, share."""
    right = F.col(chosen) == F.col(expected)
    return decisions.groupBy(episode).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(right).alias("correct"),
        F.avg(F.coalesce(right, F.lit(False)).cast("int")).alias("accuracy"))


def benchmark_summary(decisions: DataFrame, by: Sequence[str] = ("approach", "difficulty"), episode: str = "episode",
                      chosen: str = "action_type", expected: str = "expected", ms: str = "ms") -> DataFrame:
    """Accuracy in percent (mean over episodes of the share correct), mean and total time, episodes."""
    right = F.coalesce(F.col(chosen) == F.col(expected), F.lit(False)).cast("int")
    per = decisions.groupBy(*by, episode).agg(
        F.avg(right).alias("a"), F.sum(ms).alias("t"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(
        (F.avg("a") * 100).alias("accuracy"), (F.sum("t") / F.sum("n")).alias("avg_speed_ms"),
        F.sum("t").alias("total_time_ms"), F.count(F.lit(1)).alias("episodes_tested"))


def mean_by(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def pivot_mean(df: DataFrame, rows: str, columns: str, values: Sequence[str], metric: str) -> DataFrame:
    """Matrix of means; the column values are given, so no extra pass looks them up."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.avg(metric))


def best_by_metric(df: DataFrame, by: str, metric: str) -> DataFrame:
    """The key with the highest mean (first in order on ties)."""
    means = df.groupBy(by).agg(F.avg(metric).alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col(by).alias("k")))
    return means.agg(best.alias("b")).select(F.col("b.k").alias(by), (-F.col("b.m")).alias(metric))


def comparison_table(df: DataFrame, approaches: Sequence[str]) -> DataFrame:
    """Metric rows by approach columns, as formatted text."""
    # fixed values: label, source column, format
    metrics = [("Speed (ms/action)", "avg_speed_ms", "%.2f"), ("Accuracy (%)", "accuracy", "%.1f%%"),
               ("Consistency (%)", "consistency_score", "%.1f%%")]
    means = df.groupBy("approach").agg(*[F.avg(c).alias(c) for _, c, _ in metrics])
    long = means.select("approach", F.inline(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.format_string(fmt, F.col(c)).alias("text"))
        for label, c, fmt in metrics])))
    return long.groupBy("metric").pivot("approach", list(approaches)).agg(F.max("text"))


def relative_score(results: DataFrame, policy: str = "DQN", rules: str = "Specialist", base: str = "LLM") -> DataFrame:
    """Per approach: speed-up over the base approach and the radar axis 100 - ms / 15; on every row also what
    a mix of policy and rules reaches of the base's accuracy, in percent."""
    means = mean_by(results, ["approach"], ["accuracy", "avg_speed_ms"])
    policy_share, rules_share, axis = 0.8, 0.2, 15  # fixed values of the mix and of the axis

    def of(name: str, metric: str) -> Column:
        return F.max(F.when(F.col("approach") == name, F.col(metric)))

    flat = means.agg(F.struct(
        of(base, "avg_speed_ms").alias("ms"),
        ((policy_share * of(policy, "accuracy") + rules_share * of(rules, "accuracy")) / of(base, "accuracy") * 100).alias("mix")))
    m = means.withColumn("__f", flat.scalar())
    return m.select("approach", (F.col("__f.ms") / F.col("avg_speed_ms")).alias("speedup"),
                    (100 - F.col("avg_speed_ms") / axis).alias("speed_axis"), F.col("__f.mix").alias("hybrid_pct"))


def job_dashboard(jobs: DataFrame) -> DataFrame:
    """Totals over jobs: mean accuracy falls back to 95 where no job has a score."""
    done = F.col("status") == "completed"
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(done).alias("completed_jobs"),
        F.coalesce(F.avg(F.when(done, F.col("result_score") * 100)), F.lit(95.0)).alias("avg_accuracy"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("bigint").alias("rows_cleaned"),
        (100.0 * F.count_if(done) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"))


def registry_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_models"), F.sum("file_size").cast("bigint").alias("total_size"),
        (F.sum("file_size") / (1024 * 1024)).alias("total_size_mb"),
        F.array_sort(F.collect_set("difficulty")).alias("difficulties"),
        F.min(F.struct((-F.col("final_reward")).alias("r"), F.col("version").alias("v")))["v"].alias("best_model"),
        F.min(F.struct(F.col("timestamp").alias("t"), F.col("version").alias("v")))["v"].alias("oldest_model"),
        F.max(F.struct(F.col("timestamp").alias("t"), F.col("version").alias("v")))["v"].alias("newest_model"))


def list_runs(runs: DataFrame, difficulty: str | None = None, sort_by: str = "timestamp") -> DataFrame:
    """Rewards sort from high to low, everything else from low to high."""
    if difficulty:
        runs = runs.filter(F.col("difficulty") == difficulty)
    first = F.col(sort_by).desc() if sort_by in ("final_reward", "best_reward") else F.col(sort_by).asc()
    return runs.orderBy(first, F.col("version").asc())


def best_run(runs: DataFrame, metric: str = "final_reward", difficulty: str | None = None) -> DataFrame:
    """Highest reward, or fewest epochs; ties go to the lowest version."""
    if metric not in ("final_reward", "best_reward", "epochs"):
        raise ValueError(f"unknown metric: {metric}")
    if difficulty:
        runs = runs.filter(F.col("difficulty") == difficulty)
    m = F.col(metric) if metric == "epochs" else -F.col(metric)
    return runs.agg(F.min(F.struct(m.alias("m"), F.col("version").alias("v")))["v"].alias("version"))


def cleaning_summary(audit: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: total rows, cleaned rows, issues found and fixed, accuracy, duration in seconds, actions by type.

    The audit side is folded to one row per job and action before it meets the jobs.
    """
    acted = F.col("action_type") != "skip"
    per = audit.groupBy("job_id", "action_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(acted).alias("found"),
        F.count_if(acted & (F.col("reward") > 0)).alias("fixed"))
    cleaned = audit.filter(acted).groupBy("job_id").agg(F.count_distinct("row_index").alias("cleaned_rows"))
    a = per.groupBy("job_id").agg(
        F.sum("found").alias("issues_found"), F.sum("fixed").alias("issues_fixed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action_type", "n")))).alias("actions"))
    zero = F.lit(0).cast("bigint")
    return jobs.join(a, "job_id", "left").join(cleaned, "job_id", "left").select(
        "job_id", "total_rows", F.coalesce("cleaned_rows", zero).alias("cleaned_rows"),
        F.coalesce("issues_found", zero).alias("issues_found"), F.coalesce("issues_fixed", zero).alias("issues_fixed"),
        F.when(F.col("issues_found") > 0, F.col("issues_fixed") / F.col("issues_found")).otherwise(F.lit(1.0)).alias("accuracy"),
        (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("seconds"), "actions")
