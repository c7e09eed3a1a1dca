"""Ordered history, reports, paging, sampling and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import history as H
from tidemark.operators import joins as J
from tidemark.operators import reports as R
from tidemark.operators import sampling as K
from tidemark.queries import base as B
from tidemark.queries.registry import query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- windows ------------------------------------------------------------------------------------
@query("rolling_avg", f"""WITH {B.DECISIONS} SELECT row_id, CASE WHEN step >= 10 THEN round(avg(reward) OVER (PARTITION BY episode ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) END AS rolling_avg FROM decisions""")
def rolling_avg(spark, sf):
    d = B.decisions(spark, sf, steps=False)
    return r6(H.rolling_avg(d, ["episode"], "row_id", "reward").select("row_id", "rolling_avg"), "rolling_avg")


@query("recent_agent_reward", f"""WITH {B.DECISIONS} SELECT row_id, round(avg(reward) OVER (PARTITION BY agent ORDER BY row_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 10) AS recent_reward FROM decisions""")
def recent_agent_reward(spark, sf):
    d = B.decisions(spark, sf, steps=False)
    return H.recent_agent_reward(d).select("row_id", F.round("recent_reward", 10).alias("recent_reward"))


@query("last_rewards", f"""WITH {B.DECISIONS}, r AS (SELECT agent, reward, row_number() OVER (PARTITION BY agent ORDER BY row_id DESC) AS n FROM decisions) SELECT agent, round(avg(reward), 6) AS reward_avg, count(*) AS kept FROM r WHERE n <= 100 GROUP BY agent""")
def last_rewards(spark, sf):
    return r6(H.last_rewards(B.decisions(spark, sf, steps=False)), "reward_avg")


@query("progress", f"""WITH {B.DECISIONS} SELECT row_id, step - 1 AS row_index, count(*) OVER (PARTITION BY episode) AS total_rows, ((200 * (step - 1) + count(*) OVER (PARTITION BY episode)) // (2 * count(*) OVER (PARTITION BY episode))) / 100.0::DOUBLE AS progress FROM decisions""")
def progress(spark, sf):
    return H.progress(B.decisions(spark, sf, steps=False), ["episode"], "row_id").select("row_id", "row_index", "total_rows", "progress")


@query("job_progress", f"""WITH {B.JOBS} SELECT job_id, CASE WHEN total_rows > 0 THEN least(1, rows_processed / total_rows::DOUBLE) ELSE 0 END::DOUBLE AS progress FROM jobs""")
def job_progress(spark, sf):
    return B.jobs(spark, sf).select("job_id", H.job_progress(F.col("rows_processed"), F.col("total_rows")).alias("progress"))


@query("to_transitions", f"""WITH {B.DECISIONS}, t AS (SELECT row_id, confidence, lead(confidence) OVER (PARTITION BY episode ORDER BY step) AS nx, lead(row_id) OVER (PARTITION BY episode ORDER BY step) AS nid FROM decisions)
  SELECT row_id, confidence AS state, coalesce(nx, confidence) AS next_state, nid IS NULL AS done FROM t""")
def to_transitions(spark, sf):
    d = B.decisions(spark, sf).withColumn("state", F.col("confidence"))
    return H.to_transitions(d).select("row_id", "state", "next_state", "done")


@query("conversation_turns", """SELECT conv_id, turn, role, coalesce(lead(role) OVER w, role) AS next_role, lead(role) OVER w IS NULL AS done FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_turns(spark, sf):
    from tidemark.operators.segments import with_rank

    c = with_rank(B.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("state")), ["conv_id"], "turn", name="step")
    t = H.to_transitions(c, episode="conv_id")
    return t.select("conv_id", "turn", F.col("state").alias("role"), F.col("next_state").alias("next_role"), "done")


@query("buffer_last", f"""WITH {B.DECISIONS} SELECT row_id, reward FROM decisions ORDER BY row_id DESC LIMIT 1000""")
def buffer_last(spark, sf):
    return H.buffer_last(B.decisions(spark, sf, steps=False), 1000).select("row_id", "reward")


@query("top_n_per_group", f"""WITH {B.RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY final_reward DESC, version) AS place FROM runs) SELECT difficulty, version, final_reward, place::INT AS place FROM r WHERE place <= 5""")
def top_n_per_group(spark, sf):
    return H.top_n_per_group(B.runs(spark, sf), "difficulty", "final_reward", "version").select("difficulty", "version", "final_reward", "place")


@query("cumulative_reward", f"""WITH {B.DECISIONS} SELECT row_id, round(sum(reward) OVER (PARTITION BY episode ORDER BY row_id), 4) AS total_reward, step AS step_count FROM decisions""")
def cumulative_reward(spark, sf):
    d = H.cumulative_reward(B.decisions(spark, sf, steps=False), ["episode"], "row_id")
    return d.select("row_id", F.round("total_reward", 4).alias("total_reward"), "step_count")


@query("sequence_number", f"""WITH {B.DECISIONS}, e AS (SELECT row_id, unnest(issues) || ':' || "column" AS issue FROM decisions) SELECT row_id, issue, row_number() OVER (PARTITION BY issue ORDER BY row_id) AS sequence FROM e""")
def sequence_number(spark, sf):
    e = B.decisions(spark, sf, steps=False).select("row_id", F.explode("issues").alias("i"), "column").select("row_id", F.concat("i", F.lit(":"), "column").alias("issue"))
    return H.sequence_number(e, ["issue"], "row_id").select("row_id", "issue", "sequence")


@query("latest_run", f"""WITH {B.RUNS} SELECT version, "timestamp" FROM runs WHERE "timestamp" = (SELECT max("timestamp") FROM runs)""")
def latest_run(spark, sf):
    return H.latest_run(B.runs(spark, sf), "timestamp").select("version", "timestamp")


@query("latest_per_key", f"""WITH {B.RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY "timestamp" DESC, version DESC) AS n FROM runs) SELECT difficulty, version, "timestamp", epochs FROM r WHERE n = 1""")
def latest_per_key(spark, sf):
    return H.latest_per_key(B.runs(spark, sf), ["difficulty"], "timestamp", "version").select("difficulty", "version", "timestamp", "epochs")


# --- aggregates ---------------------------------------------------------------------------------
_roster = ", ".join(f"('{a}')" for a in vocab.AGENTS)


@query("agent_stats", f"""WITH {B.DECISIONS}, roster(agent) AS (VALUES {_roster}), d AS (SELECT * FROM decisions)
  SELECT roster.agent, count(d.row_id) AS usage_count, round(coalesce(avg(reward), 0), 6) AS average_reward, round(coalesce(avg((reward > 0)::INT), 0), 6) AS success_rate FROM roster LEFT JOIN d ON d.agent = roster.agent GROUP BY 1""")
def agent_stats(spark, sf):
    return r6(R.agent_stats(B.decisions(spark, sf, steps=False)), "average_reward", "success_rate")


@query("episode_summary", f"""WITH {B.DECISIONS}, a AS (SELECT episode, agent, count(*) AS n FROM decisions GROUP BY 1, 2), l AS (SELECT episode, string_agg(agent || '=' || n::VARCHAR, ',' ORDER BY agent) AS agent_usage FROM a GROUP BY 1)
  SELECT d.episode, count(*) AS total_steps, any_value(agent_usage) AS agent_usage, round(avg(confidence), 8) AS average_confidence FROM decisions d JOIN l ON d.episode = l.episode GROUP BY 1""")
def episode_summary(spark, sf):
    s = R.episode_summary(B.decisions(spark, sf, steps=False))
    uses = F.array_join(F.transform(F.map_entries("agent_usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.withColumns({"agent_usage": uses, "average_confidence": F.round("average_confidence", 8)})


@query("reward_stats", f"""WITH {B.DECISIONS} SELECT count(*) AS total_actions, round(avg(reward), 6) AS average_reward, max(reward) AS max_reward, min(reward) AS min_reward, count(*) FILTER (reward > 0) AS positive_actions, count(*) FILTER (reward < 0) AS negative_actions FROM decisions""")
def reward_stats(spark, sf):
    return r6(R.reward_stats(B.decisions(spark, sf, steps=False)), "average_reward")


@query("reward_by_action", f"""WITH {B.DECISIONS} SELECT action_type, count(*) AS n, round(avg(reward), 6) AS average_reward, round(sum(reward), 4) AS total_reward FROM decisions GROUP BY 1""")
def reward_by_action(spark, sf):
    d = r6(R.reward_by_action(B.decisions(spark, sf, steps=False)), "average_reward")
    return d.withColumn("total_reward", F.round("total_reward", 4))


@query("action_counts", f"""WITH {B.AUDIT} SELECT action_type, agent_used AS agent, count(*) AS n FROM audit GROUP BY ROLLUP (action_type, agent_used)""")
def action_counts(spark, sf):
    return R.action_counts(B.audit(spark, sf).withColumnRenamed("agent_used", "agent"), totals=True)


BOUNDS = [60, 600, 3600, 10000]


@query("duration_histogram", f"""WITH {B.JOBS}, d AS (SELECT job_type, date_diff('second', started_at, completed_at) AS s FROM jobs)
  {' UNION ALL '.join(f"SELECT job_type, '{b}' AS le, count(*) FILTER (s <= {b}) AS n FROM d GROUP BY 1" for b in BOUNDS)} UNION ALL SELECT job_type, '+Inf', count(s) FROM d GROUP BY 1""")
def duration_histogram(spark, sf):
    j = B.jobs(spark, sf).select("job_type", (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("s"))
    return R.duration_histogram(j, "s", BOUNDS, by=["job_type"])


@query("transition_stats", f"""WITH {B.DECISIONS}, t AS (SELECT reward, confidence + 0.01::DOUBLE AS priority, lead(row_id) OVER (PARTITION BY episode ORDER BY step) IS NULL AS done FROM decisions)
  SELECT count(*) AS size, round(count(*) / 20000.0::DOUBLE, 6) AS utilization, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, min(reward) AS reward_min, max(reward) AS reward_max, round(avg(done::INT), 6) AS done_rate,
    round(avg(priority), 6) AS priority_mean, round(stddev_pop(priority), 6) AS priority_std, round(min(priority), 6) AS priority_min, round(max(priority), 6) AS priority_max FROM t""")
def transition_stats(spark, sf):
    d = B.decisions(spark, sf).withColumns({"state": F.col("confidence"), "priority": F.col("confidence") + 0.01})
    s = R.transition_stats(H.to_transitions(d), 20000)
    return r6(s, "utilization", "reward_mean", "reward_std", "done_rate", "priority_mean", "priority_std", "priority_min", "priority_max")


@query("run_report", f"""WITH {B.DECISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY row_id DESC) AS n FROM decisions)
  SELECT episode, max(reward) AS best_reward, min(reward) AS worst_reward, arg_max(confidence, row_id) AS final_epsilon, count(*) AS total_transitions, round(avg(reward) FILTER (n <= 10), 6) AS final_avg_reward, round(stddev_pop(reward) FILTER (n <= 10), 6) AS final_std_reward FROM r GROUP BY episode""")
def run_report(spark, sf):
    d = B.decisions(spark, sf, steps=False).withColumnRenamed("confidence", "epsilon")
    return r6(R.run_report(d, "episode", "row_id"), "final_avg_reward", "final_std_reward")


@query("evaluation_report", f"""WITH {B.DECISIONS}, e AS (SELECT sum(reward) AS t, count(*) AS s FROM decisions GROUP BY episode) SELECT round(avg(t), 6) AS avg_reward, round(avg(s), 6) AS avg_steps, round(avg((t > 0)::INT), 6) AS success_rate FROM e""")
def evaluation_report(spark, sf):
    e = B.decisions(spark, sf, steps=False).groupBy("episode").agg(F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("steps"))
    return r6(R.evaluation_report(e), "avg_reward", "avg_steps", "success_rate")


@query("benchmark_summary", f"""WITH {B.RESULTS}, e AS (SELECT approach, difficulty, episode, avg((action_type = expected)::INT) AS a, sum(avg_speed_ms) AS t, count(*) AS n FROM results GROUP BY 1, 2, 3)
  SELECT approach, difficulty, round(avg(a) * 100, 6) AS accuracy, round(sum(t) / sum(n), 6) AS avg_speed_ms, round(sum(t), 4) AS total_time_ms, count(*) AS episodes_tested FROM e GROUP BY 1, 2""")
def benchmark_summary(spark, sf):
    s = r6(R.benchmark_summary(B.results(spark, sf).withColumnRenamed("avg_speed_ms", "ms")), "accuracy", "avg_speed_ms")
    return s.withColumn("total_time_ms", F.round("total_time_ms", 4))


@query("mean_by", f"""WITH {B.RESULTS} SELECT approach, difficulty, round(avg(accuracy), 6) AS accuracy, round(avg(avg_speed_ms), 6) AS avg_speed_ms, round(avg(consistency_score), 6) AS consistency_score FROM results GROUP BY 1, 2""")
def mean_by(spark, sf):
    m = ["accuracy", "avg_speed_ms", "consistency_score"]
    return r6(R.mean_by(B.results(spark, sf), ["approach", "difficulty"], m), *m)


APPROACHES = ["DQN", "Specialist", "LLM"]


@query("pivot_mean", f"""WITH {B.RESULTS} SELECT difficulty, {', '.join(f"round(avg(accuracy) FILTER (approach = '{a}'), 6) AS " + '"' + a + '"' for a in APPROACHES)} FROM results GROUP BY 1""")
def pivot_mean(spark, sf):
    return r6(R.pivot_mean(B.results(spark, sf), "difficulty", "approach", APPROACHES, "accuracy"), *APPROACHES)


@query("best_by_metric", f"""WITH {B.RESULTS} SELECT approach, round(avg(avg_speed_ms), 6) AS avg_speed_ms FROM results GROUP BY 1 ORDER BY avg(avg_speed_ms) DESC, approach LIMIT 1""")
def best_by_metric(spark, sf):
    return r6(R.best_by_metric(B.results(spark, sf), "approach", "avg_speed_ms"), "avg_speed_ms")


def _sql_cells(expr):
    return ", ".join(f"max({expr}) FILTER (approach = '{a}') AS " + '"' + a + '"' for a in APPROACHES)


@query("comparison_table", f"""WITH {B.RESULTS}, m AS (SELECT approach, avg(avg_speed_ms) AS s, avg(accuracy) AS a, avg(consistency_score) AS c FROM results GROUP BY 1)
  SELECT 'Speed (ms/action)' AS metric, {_sql_cells("printf('%.2f', s)")} FROM m UNION ALL SELECT 'Accuracy (%)', {_sql_cells("printf('%.1f%%', a)")} FROM m UNION ALL SELECT 'Consistency (%)', {_sql_cells("printf('%.1f%%', c)")} FROM m""")
def comparison_table(spark, sf):
    return R.comparison_table(B.results(spark, sf), APPROACHES)


@query("relative_score", f"""WITH {B.RESULTS}, m AS (SELECT approach, avg(avg_speed_ms) AS s, avg(accuracy) AS a FROM results GROUP BY 1), f AS (SELECT max(s) FILTER (approach = 'LLM') AS ms,
    (0.8::DOUBLE * max(a) FILTER (approach = 'DQN') + 0.2::DOUBLE * max(a) FILTER (approach = 'Specialist')) / max(a) FILTER (approach = 'LLM') * 100 AS mix FROM m)
  SELECT approach, round(ms / s, 6) AS speedup, round(100 - s / 15, 6) AS speed_axis, round(mix, 6) AS hybrid_pct FROM m, f""")
def relative_score(spark, sf):
    return r6(R.relative_score(B.results(spark, sf)), "speedup", "speed_axis", "hybrid_pct")


@query("job_dashboard", f"""WITH {B.JOBS} SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, round(coalesce(avg(result_score * 100) FILTER (status = 'completed'), 95), 6) AS avg_accuracy,
  coalesce(sum(rows_processed), 0)::BIGINT AS rows_cleaned, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / greatest(count(*), 1), 6) AS success_rate FROM jobs""")
def job_dashboard(spark, sf):
    return r6(R.job_dashboard(B.jobs(spark, sf)), "avg_accuracy", "success_rate")


@query("registry_stats", f"""WITH {B.RUNS} SELECT count(*) AS total_models, sum(file_size)::BIGINT AS total_size, round(sum(file_size)::DOUBLE / 1048576, 6) AS total_size_mb, string_agg(DISTINCT difficulty, ',' ORDER BY difficulty) AS difficulties,
  (SELECT version FROM runs ORDER BY final_reward DESC, version LIMIT 1) AS best_model, (SELECT version FROM runs ORDER BY "timestamp", version LIMIT 1) AS oldest_model, (SELECT version FROM runs ORDER BY "timestamp" DESC, version DESC LIMIT 1) AS newest_model FROM runs""")
def registry_stats(spark, sf):
    return r6(R.registry_stats(B.runs(spark, sf)).withColumn("difficulties", F.array_join("difficulties", ",")), "total_size_mb")


@query("cleaning_summary", f"""WITH {B.JOBS}, {B.AUDIT}, a AS (SELECT job_id, count(DISTINCT row_index) FILTER (action_type <> 'skip') AS cleaned_rows, count(*) FILTER (action_type <> 'skip') AS f, count(*) FILTER (action_type <> 'skip' AND reward > 0) AS x FROM audit GROUP BY 1),
  n AS (SELECT job_id, string_agg(action_type || '=' || n::VARCHAR, ',' ORDER BY action_type) AS actions FROM (SELECT job_id, action_type, count(*) AS n FROM audit GROUP BY 1, 2) GROUP BY 1)
  SELECT j.job_id, total_rows, coalesce(cleaned_rows, 0) AS cleaned_rows, coalesce(f, 0) AS issues_found, coalesce(x, 0) AS issues_fixed, round(CASE WHEN f > 0 THEN x / f::DOUBLE ELSE 1 END, 6) AS accuracy,
    date_diff('second', started_at, completed_at) AS seconds, actions FROM jobs j LEFT JOIN a USING (job_id) LEFT JOIN n USING (job_id)""")
def cleaning_summary(spark, sf):
    s = R.cleaning_summary(B.audit(spark, sf), B.jobs(spark, sf))
    text = F.array_join(F.transform(F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r6(s.withColumn("actions", text), "accuracy")


# --- lookups ------------------------------------------------------------------------------------
@query("jobs_with_dataset", f"""WITH {B.JOBS} SELECT job_id, status, dataset_id, c_name AS filename FROM jobs JOIN customer ON c_custkey = dataset_id""")
def jobs_with_dataset(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("filename"))
    return J.jobs_with_dataset(B.jobs(spark, sf), c).select("job_id", "status", "dataset_id", "filename")


@query("audit_for_job", f"""WITH {B.AUDIT} SELECT id, action_type, row_index, reward FROM audit WHERE job_id = (SELECT max(l_orderkey) FROM lineitem)""")
def audit_for_job(spark, sf):
    a = B.audit(spark, sf)
    newest = a.agg(F.max("job_id")).scalar()
    return J.audit_for_job(a, newest).select("id", "action_type", "row_index", "reward")


# --- order, paging, sampling ----------------------------------------------------------------------
@query("newest_jobs_page", f"""WITH {B.JOBS} SELECT job_id, status FROM jobs ORDER BY coalesce(started_at, created_at, TIMESTAMP '1970-01-01') DESC, job_id LIMIT 25 OFFSET 50""")
def newest_jobs_page(spark, sf):
    return K.page(K.newest_jobs(B.jobs(spark, sf)), 3, 25).select("job_id", "status")


@query("page_count", f"""WITH {B.JOBS} SELECT status, ceil(count(*) / 25.0::DOUBLE)::BIGINT AS pages FROM jobs GROUP BY 1""")
def page_count(spark, sf):
    return B.jobs(spark, sf).groupBy("status").agg(K.page_count(F.count(F.lit(1)), 25).alias("pages"))


@query("preview", f"""WITH {B.DIRTY} SELECT row_id, name, age FROM dirty ORDER BY row_id LIMIT 5""")
def preview(spark, sf):
    return K.preview(B.dirty(spark, sf)).select("row_id", "name", "age")


@query("list_runs", f"""WITH {B.RUNS} SELECT version, final_reward, epochs FROM runs WHERE difficulty = 'easy'""")
def list_runs(spark, sf):
    return R.list_runs(B.runs(spark, sf), "easy", "final_reward").select("version", "final_reward", "epochs")


@query("best_run", f"""WITH {B.RUNS} SELECT 'final_reward' AS metric, (SELECT version FROM runs WHERE difficulty = 'hard' ORDER BY final_reward DESC, version LIMIT 1) AS version UNION ALL SELECT 'epochs', (SELECT version FROM runs ORDER BY epochs, version LIMIT 1)""")
def best_run(spark, sf):
    r = B.runs(spark, sf)
    a = R.best_run(r, "final_reward", "hard").select(F.lit("final_reward").alias("metric"), "version")
    return a.unionByName(R.best_run(r, "epochs").select(F.lit("epochs").alias("metric"), "version"))


@query("sample_uniform", f"""WITH {B.DECISIONS} SELECT row_id, reward FROM decisions ORDER BY md5('42|' || row_id::VARCHAR), row_id LIMIT 64""")
def sample_uniform(spark, sf):
    return K.sample_uniform(B.decisions(spark, sf, steps=False), 64).select("row_id", "reward")


@query("sample_prioritized", f"""WITH {B.DECISIONS},
  d AS (SELECT row_id, confidence + 0.01::DOUBLE AS priority, greatest(round(pow(confidence + 0.01::DOUBLE, 0.6::DOUBLE) * 1e6::DOUBLE), 1)::HUGEINT AS chance FROM decisions),
  r AS (SELECT *, sum(chance) OVER (ORDER BY row_id) AS upto, sum(chance) OVER () AS total, count(*) OVER () AS n FROM d),
  u AS (SELECT range AS draw, floor(({B.sql_hash("'42'", "'draw'", "range::VARCHAR")} * 1048576 + {B.sql_hash("'42'", "'draw_low'", "range::VARCHAR")} % 1048576)::DOUBLE / 4503599627370496.0::DOUBLE
      * (SELECT sum(chance) FROM d)::DOUBLE)::HUGEINT AS place FROM range(256)),
  hit AS (SELECT draw, row_id, priority, pow(n * (chance::DOUBLE / total::DOUBLE), -0.4::DOUBLE) AS w FROM u JOIN r ON place >= upto - chance AND place < upto)
  SELECT draw, row_id, round(priority, 8) AS priority, round(w / max(w) OVER (), 6) AS weight FROM hit""")
def sample_prioritized(spark, sf):
    d = B.decisions(spark, sf, steps=False).select("row_id", "reward", (F.col("confidence") + 0.01).alias("priority"))
    return K.sample_prioritized(d, 256).select("draw", "row_id", F.round("priority", 8).alias("priority"), F.round("weight", 6).alias("weight"))


@query("update_priorities", f"""WITH {B.DECISIONS}, u AS (SELECT row_id AS k, reward AS td FROM decisions WHERE row_id % 3 = 0) SELECT row_id, round(coalesce(abs(td) + 1e-6::DOUBLE, confidence), 8) AS priority FROM decisions LEFT JOIN u ON k = row_id""")
def update_priorities(spark, sf):
    d = B.decisions(spark, sf, steps=False).select("row_id", F.col("confidence").alias("priority"), F.col("reward"))
    up = d.filter("row_id % 3 = 0").select("row_id", F.col("reward").alias("td_error"))
    return K.update_priorities(d, up).select("row_id", F.round("priority", 8).alias("priority"))
