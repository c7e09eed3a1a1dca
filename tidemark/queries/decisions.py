"""Recommendations, choices and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import decide as D
from tidemark.operators import rewards as R
from tidemark.operators.clean import category_lookup
from tidemark.operators.detect import detect_issues, expected_action, legal_actions, people_rules
from tidemark.operators.history import last_rewards
from tidemark.operators.reports import benchmark_summary, decision_accuracy
from tidemark.plans.cleaning import decide
from tidemark.queries import base as B
from tidemark.queries.detection import found, found_all, SQL_EXPECTED
from tidemark.queries.registry import query

MAPPED = ", ".join(f"'{k}'" for k in vocab.CATEGORY_MAP)
_map_case = "CASE dept " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.CATEGORY_MAP.items()) + " END"
_gap = "list_filter(issues, lambda x: starts_with(x, 'missing:'))[1]"


def _bands(c):
    (a, b), (x, y) = vocab.OUTLIER_BANDS[c]
    return f"CASE WHEN {c} < {a} OR {c} > {b} THEN 0.9 WHEN {c} < {x} OR {c} > {y} THEN 0.7 ELSE 0.5 END"


# one row per row and proposing agent, as the specialists would propose with the literal category map
CANDIDATES = f"""{B.ALL_ISSUES},
gaps AS (SELECT *, split_part({_gap}, ':', 2) AS gap FROM found),
cand AS (
  SELECT row_id, 0 AS pos, 'FillMissingAgent' AS agent, 'fill_missing' AS action_type, gap AS col,
    CASE gap {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FILL_DEFAULTS.items())} END AS value,
    CASE gap {' '.join(f"WHEN '{k}' THEN {v}" for k, v in vocab.FILL_CONFIDENCE.items())} ELSE 0.3 END::DOUBLE AS confidence,
    {B.sql_count('issues', 'missing:')} AS matching FROM gaps WHERE {B.sql_any('issues', 'missing:')}
  UNION ALL SELECT row_id, 1, 'DuplicateDetector', 'remove_duplicate', 'id', NULL, 1.0, {B.sql_count('issues', 'duplicate')} FROM found WHERE {B.sql_has('issues', 'duplicate')}
  UNION ALL SELECT row_id, 2, 'OutlierHandler', 'remove_outlier', CASE WHEN {B._outside('age', 'age')} THEN 'age' ELSE 'salary' END, CASE WHEN {B._outside('age', 'age')} THEN '35' ELSE '75000' END,
    CASE WHEN {B._outside('age', 'age')} THEN {_bands('age')} ELSE {_bands('salary')} END, {B.sql_count('issues', 'outlier')}
    FROM found WHERE {B.sql_has('issues', 'outlier')} AND ({B._outside('age', 'age')} OR {B._outside('salary', 'salary')})
  UNION ALL SELECT row_id, 3, 'CategoryStandardizer', 'fix_category', 'dept', {_map_case}, 1.0, {B.sql_count('issues', 'category', 'formatting')}
    FROM found WHERE ({B.sql_has('issues', 'category')} OR {B.sql_has('issues', 'formatting')}) AND dept IN ({MAPPED})
  UNION ALL SELECT row_id, 4, 'SkipAgent', 'skip', 'id', NULL, 0.2, 0 FROM found),
scored0 AS (SELECT *, CASE WHEN matching > 0 THEN least(1.0::DOUBLE, 0.3::DOUBLE + matching * 0.2::DOUBLE) ELSE 0.0::DOUBLE END AS expertise FROM cand)"""


# fixed values: the share of text that a misspelled department has in common with the closest known one
DEPT_RATIOS = {"enginering": "20 / 21", "salse": "4 / 5", "marketting": "18 / 19", "h.r": "4 / 5", "financ": "12 / 13"}
# the same with the closest known value instead of the literal map
FUZZY_CANDIDATES = CANDIDATES.replace(_map_case, "CASE dept " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in vocab.DEPT_TYPOS.items()) + " END") \
    .replace(f"dept IN ({MAPPED})", "dept IN (" + ", ".join(f"'{v}'" for v in vocab.DEPT_TYPOS.values()) + ")") \
    .replace(" END, 1.0, ", " END, CASE dept " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in DEPT_RATIOS.items()) + " END, ")


def candidates(spark, sf):
    f = found_all(spark, sf)
    f = f.withColumn("legal", legal_actions(F.col("issues")))
    return D.recommend(f, D.default_specialists(f, F.col("issues"), F.col("legal"), fuzzy=False))


@query("recommend", f"""WITH {B.DIRTY}, {CANDIDATES} SELECT row_id, agent, action_type, col AS "column", value, round(confidence, 6) AS confidence, round(expertise, 6) AS expertise FROM scored0""")
def recommend(spark, sf):
    c = candidates(spark, sf).select("row_id", F.explode_outer("candidates").alias("c"))
    return c.select("row_id", "c.agent", "c.action_type", "c.column", "c.value", F.round("c.confidence", 6).alias("confidence"),
                    F.round("c.expertise", 6).alias("expertise"))


@query("recommend_fuzzy", f"""WITH {B.DIRTY}, {FUZZY_CANDIDATES} SELECT row_id, agent, action_type, col AS "column", value, round(confidence, 6) AS confidence FROM scored0""")
def recommend_fuzzy(spark, sf):
    f = found_all(spark, sf).withColumn("legal", legal_actions(F.col("issues")))
    c = D.recommend(f, D.default_specialists(f, F.col("issues"), F.col("legal"))).select("row_id", F.explode_outer("candidates").alias("c"))
    return c.select("row_id", "c.agent", "c.action_type", "c.column", "c.value", F.round("c.confidence", 6).alias("confidence"))


def _choose(history: str) -> str:
    return f"""best AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, pos) AS rn FROM (
    SELECT s.*, 0.4::DOUBLE * confidence + 0.3::DOUBLE * greatest(0, least(1, {history} + 0.5::DOUBLE)) + 0.3::DOUBLE * expertise AS score FROM scored0 s))"""


@query("choose_action", f"""WITH {B.DIRTY}, {CANDIDATES}, {_choose('0.0::DOUBLE')}
  SELECT row_id, agent, action_type, col AS "column", value, round(score, 6) AS score FROM best WHERE rn = 1""")
def choose_action(spark, sf):
    d = D.choose_action(candidates(spark, sf))
    return d.select("row_id", "decision.agent", "decision.action_type", "decision.column", "decision.value", F.round("decision.score", 6).alias("score"))


def _cell(c: str, gap: str, more: str = "") -> str:
    return f"CASE WHEN a = 'fill_missing' AND c = '{c}' AND {gap} THEN v{'::BIGINT' if c in ('age', 'salary') else ''} {more} ELSE {c} END AS {c}"


def _outlying(c: str) -> str:
    return f"WHEN a = 'remove_outlier' AND c = '{c}' AND {B._outside(c, c)} THEN v::BIGINT"


# every row after its decided action, and whether it goes: an earlier row has the same keys after its own action
JOB = f"""{CANDIDATES}, {_choose('0.0::DOUBLE')},
decided AS (SELECT row_id, agent, action_type AS a, col AS c, value AS v, confidence FROM best WHERE rn = 1),
changed AS (SELECT row_id, id, name AS k1, email AS k2, a, c, agent, confidence, issues,
    {_cell('name', 'name IS NULL')}, {_cell('age', 'age IS NULL', _outlying('age'))}, {_cell('salary', 'salary IS NULL', _outlying('salary'))},
    {_cell('score', 'score IS NULL')}, {_cell('dept', 'dept IS NULL', "WHEN a = 'fix_category' AND c = 'dept' AND v <> dept THEN v")}, {_cell('email', 'email IS NULL')}
  FROM found JOIN decided USING (row_id)),
job_firsts AS (SELECT name AS f1, email AS f2, min(row_id) AS first_id FROM changed GROUP BY 1, 2),
done AS (SELECT n.*, a = 'remove_duplicate' AND coalesce(first_id < row_id, false) AS removed FROM changed n LEFT JOIN job_firsts ON k1 IS NOT DISTINCT FROM f1 AND k2 IS NOT DISTINCT FROM f2)"""


def _job(spark, sf):
    from tidemark.plans.cleaning import cleaning_job

    return cleaning_job(B.dirty(spark, sf).drop("truth"), "job-1", F.lit("2026-01-01").cast("timestamp"), fuzzy=False)


@query("job_cleaned", f"""WITH {B.DIRTY}, {JOB} SELECT row_id, id, name, age, salary, score, dept, email FROM done WHERE NOT removed""")
def job_cleaned(spark, sf):
    return _job(spark, sf).cleaned.select("row_id", "id", "name", "age", "salary", "score", "dept", "email")


@query("job_audit", f"""WITH {B.DIRTY}, {JOB} SELECT 'job-1-' || row_id::VARCHAR AS id, row_id AS row_index, a AS action_type, c AS "column", agent AS agent_used, round(confidence, 6) AS confidence,
  round(CASE WHEN a = 'skip' THEN CASE WHEN len(issues) > 0 THEN -0.05 ELSE 0.05 END ELSE 0.2 + 0.05 * least(len(issues), 3) END::DOUBLE, 6) AS reward FROM done""")
def job_audit(spark, sf):
    return _job(spark, sf).audit.select("id", "row_index", "action_type", "column", "agent_used", F.round("confidence", 6).alias("confidence"), F.round("reward", 6).alias("reward"))


_last100 = """last AS (SELECT agent, avg(reward) AS a FROM (SELECT agent, reward, row_number() OVER (PARTITION BY agent ORDER BY row_id DESC) AS r FROM decisions) WHERE r <= 100 GROUP BY agent)"""


@query("choose_action_history", f"""WITH {B.DIRTY}, {CANDIDATES}, {B.DECISIONS}, {_last100}, {_choose('coalesce((SELECT a FROM last l WHERE l.agent = s.agent), 0)')}
  SELECT row_id, agent, action_type, round(score, 6) AS score FROM best WHERE rn = 1""")
def choose_action_history(spark, sf):
    d = D.choose_action(candidates(spark, sf), history=last_rewards(B.decisions(spark, sf, steps=False)))
    return d.select("row_id", "decision.agent", "decision.action_type", F.round("decision.score", 6).alias("score"))


@query("batch_reward", f"""WITH {B.DECISIONS} SELECT row_id, round(CASE WHEN action_type = 'skip' THEN CASE WHEN len(issues) > 0 THEN -0.05 ELSE 0.05 END ELSE 0.2 + 0.05 * least(len(issues), 3) END::DOUBLE, 6) AS reward FROM decisions""")
def batch_reward(spark, sf):
    d = B.decisions(spark, sf, steps=False)
    return d.select("row_id", F.round(R.batch_reward(F.col("action_type"), F.col("issues")), 6).alias("reward"))


_sql_step = "CASE action_type " + " ".join(f"WHEN '{k}' THEN CASE WHEN ok THEN {g} ELSE {b} END" for k, (g, b) in vocab.STEP_REWARDS.items()) + " ELSE -0.3 END::DOUBLE"


@query("step_reward", f"""WITH {B.DECISIONS}, d AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN 'dance' WHEN row_id % 11 = 1 THEN 'fix_type' WHEN row_id % 11 = 2 THEN 'fix_formatting' ELSE action_type END AS action_type, row_id % 3 = 0 AS ok FROM decisions)
  SELECT row_id, {_sql_step} AS reward FROM d""")
def step_reward(spark, sf):
    k = F.col("row_id") % 11
    d = B.decisions(spark, sf, steps=False).withColumn("action_type", F.when(k == 0, "dance").when(k == 1, "fix_type").when(k == 2, "fix_formatting").otherwise(F.col("action_type")))
    return d.select("row_id", R.step_reward(F.col("action_type"), F.col("row_id") % 3 == 0).alias("reward"))


_sql_base = "CASE action_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.BASE_REWARDS.items()) + " ELSE 0 END::DOUBLE"
_sql_adj = (f"CASE action_type WHEN 'fill_missing' THEN 0.1 * {B.sql_count('issues', 'missing:')} WHEN 'remove_duplicate' THEN 0.1 * {B.sql_count('issues', 'duplicate')} "
            f"WHEN 'remove_outlier' THEN 0.1 * {B.sql_count('issues', 'outlier')} WHEN 'fix_category' THEN 0.05 * {B.sql_count('issues', 'category', 'formatting')} "
            f"WHEN 'fix_type' THEN 0.05 * {B.sql_count('issues', 'type')} ELSE 0 END::DOUBLE")
_sql_skip = f"CASE WHEN action_type = 'skip' AND NOT ({B.sql_any('issues', 'missing:')} OR {B.sql_any('issues', 'duplicate')} OR {B.sql_any('issues', 'outlier')}) THEN 0.1 ELSE 0 END::DOUBLE"


@query("reward_terms", f"""WITH {B.DECISIONS} SELECT row_id, {_sql_base} AS base, round({_sql_adj}, 6) AS adjustment, {_sql_skip} AS skip_bonus FROM decisions""")
def reward_terms(spark, sf):
    a, i = F.col("action_type"), F.col("issues")
    return B.decisions(spark, sf, steps=False).select("row_id", R.base_reward(a).alias("base"), F.round(R.issue_adjustment(a, i), 6).alias("adjustment"), R.skip_bonus(a, i).alias("skip_bonus"))


_sql_contra = """CASE WHEN len(list_filter(prev, lambda x: x.c IS NOT DISTINCT FROM "column" AND x.a <> action_type AND x.a <> 'skip')) > 0 THEN -0.2 ELSE 0 END::DOUBLE"""
SHAPED = f"""t AS (SELECT d.*, count(*) OVER (PARTITION BY episode) AS total_steps,
    coalesce(list({{'a': action_type, 'c': "column"}}) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS prev,
    count(*) OVER (PARTITION BY episode, action_type ORDER BY step RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS same FROM decisions d),
shaped AS (SELECT *, {_sql_contra} AS contradiction, CASE WHEN same > 0 THEN 0.1 ELSE 0 END::DOUBLE AS consistency, floor(step / total_steps::DOUBLE * 5) * 0.05::DOUBLE AS progress FROM t)"""


@query("shaped_reward_repairs", f"""WITH {B.DECISIONS}, {SHAPED} SELECT row_id, total_steps, contradiction, consistency,
  round(greatest(-1, least(1, {_sql_base} + progress + consistency + contradiction + {_sql_adj})), 6) AS reward FROM shaped WHERE action_type <> 'skip'""")
def shaped_reward_repairs(spark, sf):
    return R.repair_rewards(B.decisions(spark, sf)).select("row_id", "total_steps", "contradiction", "consistency", F.round("reward", 6).alias("reward"))


# row after row of an episode's action, with the signs of its last hundred steps
_sql_bonus = "CASE WHEN len(h) = 0 THEN 0 WHEN len(list_filter(h, lambda x: x.p)) / len(h)::DOUBLE >= 0.8 THEN 0.1 WHEN len(list_filter(h, lambda x: x.p)) / len(h)::DOUBLE >= 0.6 THEN 0.05 ELSE 0 END::DOUBLE"
SIGNED = f"""{SHAPED},
terms AS (SELECT row_id, episode, action_type, step, {_sql_base} + progress AS earlier, contradiction AS clash, {_sql_adj} AS adj, {_sql_skip} AS bonus,
    row_number() OVER (PARTITION BY episode, action_type ORDER BY step) AS k FROM shaped),
signed AS (
  SELECT row_id, episode, action_type, step, k, 0::DOUBLE AS steady, earlier + 0 + clash + adj + bonus AS total, [{{'s': step, 'p': earlier + 0 + clash + adj + bonus > 0}}] AS seen
  FROM terms WHERE k = 1
  UNION ALL
  SELECT row_id, episode, action_type, step, k, steady, earlier + steady + clash + adj + bonus, list_append(h, {{'s': step, 'p': earlier + steady + clash + adj + bonus > 0}})
  FROM (SELECT *, {_sql_bonus} AS steady FROM (SELECT t.*, list_filter(r.seen, lambda x: x.s >= t.step - 100) AS h
    FROM signed r JOIN terms t ON t.episode = r.episode AND t.action_type = r.action_type AND t.k = r.k + 1)))"""


@query("shaped_reward", f"""WITH RECURSIVE {B.DECISIONS}, {SIGNED} SELECT row_id, action_type, steady AS consistency, round(greatest(-1, least(1, total)), 6) AS reward FROM signed""")
def shaped_reward(spark, sf):
    return R.shaped_reward(B.decisions(spark, sf)).select("row_id", "action_type", "consistency", F.round("reward", 6).alias("reward"))


@query("progress_bonus", f"""WITH {B.DECISIONS} SELECT row_id, round(floor(step / count(*) OVER (PARTITION BY episode)::DOUBLE * 5) * 0.05::DOUBLE, 6) AS bonus FROM decisions""")
def progress_bonus(spark, sf):
    d = R.with_total_steps(B.decisions(spark, sf))
    return d.select("row_id", F.round(R.progress_bonus(F.col("step"), F.col("total_steps")), 6).alias("bonus"))


@query("contradiction", f"""WITH {B.DECISIONS}, {SHAPED} SELECT row_id, contradiction FROM shaped""")
def contradiction(spark, sf):
    return R.with_contradiction(B.decisions(spark, sf)).select("row_id", "contradiction")


@query("consistency", f"""WITH {B.DECISIONS}, s AS (SELECT row_id, avg((reward > 0)::INT) OVER (PARTITION BY episode, action_type ORDER BY step RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS share FROM decisions)
  SELECT row_id, CASE WHEN share >= 0.8 THEN 0.1 WHEN share >= 0.6 THEN 0.05 ELSE 0 END::DOUBLE AS consistency FROM s""")
def consistency(spark, sf):
    return R.with_consistency(B.decisions(spark, sf), F.col("reward") > 0).select("row_id", "consistency")


@query("completion_bonus", f"""WITH {B.JOBS} SELECT job_id, CASE WHEN result_score >= 0.9 THEN 0.5 WHEN result_score >= 0.8 THEN 0.3 WHEN result_score >= 0.7 THEN 0.2 WHEN result_score >= 0.6 THEN 0.1 ELSE 0 END::DOUBLE AS bonus FROM jobs""")
def completion_bonus(spark, sf):
    return B.jobs(spark, sf).select("job_id", R.completion_bonus(F.col("result_score")).alias("bonus"))


_flags = ", ".join(f"list_contains(issues, '{i}')::INT" for i in vocab.OBSERVED_ISSUES)
_legal = f"1, ({B.sql_any('issues', 'missing:')})::INT, 1, 1, 1, ({B.sql_any('issues', 'wrong_type:')})::INT, ({B.sql_any('issues', 'formatting:')})::INT"


@query("encode_observation", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, concat_ws(',', coalesce(age, 0)::BIGINT, coalesce(salary, 0)::BIGINT, coalesce({B.sql_number('score')}, 0)::BIGINT,
  coalesce((dept <> '')::INT, 0), coalesce((name <> '')::INT, 0), coalesce((email <> '')::INT, 0), {_flags}, {_legal}, {', '.join(['0'] * 25)}) AS state FROM found""")
def encode_observation(spark, sf):
    f = found(spark, sf)
    d = D.encode_observation(f.withColumn("legal", legal_actions(F.col("issues"))))
    return d.select("row_id", F.concat_ws(",", F.transform("state", lambda x: x.cast("bigint").cast("string"))).alias("state"))


_acts = ", ".join(f"'{a}'" for a in vocab.ACTIONS)


@query("masked_argmax", f"""WITH s AS (SELECT vec_id, embedding[1:7] AS q, list_filter([{_acts}], lambda a, i: (vec_id + label) % (i + 1) = 0) AS legal FROM embeddings),
  o AS (SELECT vec_id, q, list_filter([{', '.join(f"{{'q': -(q[{i + 1}]::DOUBLE), 'i': {i}, 'a': '{a}'}}" for i, a in enumerate(vocab.ACTIONS))}], lambda x: list_contains(legal, x.a)) AS o FROM s)
  , b AS (SELECT vec_id, CASE WHEN len(o) > 0 THEN list_sort(o)[1].a ELSE 'skip' END AS action, round(CASE WHEN len(o) > 0 THEN least(1, list_max(q)::DOUBLE / 10) ELSE 0 END, 6) AS confidence FROM o)
  SELECT vec_id, action, CASE action {' '.join(f"WHEN '{a}' THEN '{c}'" for a, (c, _) in vocab.POLICY_TARGETS.items())} END AS "column",
    CASE action {' '.join(f"WHEN '{a}' THEN '{v}'" for a, (_, v) in vocab.POLICY_TARGETS.items() if v)} END AS value, confidence FROM b""")
def masked_argmax(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 7).alias("q"))
    legal = F.filter(F.array(*[F.lit(a) for a in vocab.ACTIONS]), lambda a, i: (F.col("vec_id") + F.col("label")) % (i + 2) == 0)
    best = D.policy_action(F.col("q"), legal)
    return e.select("vec_id", best["action_type"].alias("action"), best["column"].alias("column"), best["value"].alias("value"),
                    F.round(best["confidence"], 6).alias("confidence"))


@query("route", f"""WITH {B.DECISIONS} SELECT row_id, CASE WHEN confidence > 0.8 THEN 'policy' ELSE 'rules' END AS route FROM decisions""")
def route(spark, sf):
    return B.decisions(spark, sf, steps=False).select("row_id", D.route(F.col("confidence")).alias("route"))


_rules = [("missing:age", "fill_missing", "age", "30"), ("missing:salary", "fill_missing", "salary", "60000"), ("missing:score", "fill_missing", "score", "80"),
          ("missing:name", "fill_missing", "name", "unknown"), ("wrong_type:score", "fix_type", "score", None), ("formatting:email", "fix_formatting", "email", None),
          ("formatting:name", "fix_formatting", "name", None), ("formatting:dept", "fix_category", "dept", None)]


def _rule_case(i, other):
    return "CASE " + " ".join(f"WHEN list_contains(issues, '{r[0]}') THEN " + ("NULL" if r[i] is None else f"'{r[i]}'") for r in _rules) + f" ELSE {other} END"


@query("rule_action", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, {_rule_case(1, "'skip'")} AS action_type, {_rule_case(2, "'id'")} AS "column", {_rule_case(3, "NULL")} AS value FROM found""")
def rule_action(spark, sf):
    f = found(spark, sf).withColumn("legal", legal_actions(F.col("issues")))
    return D.rule_action(f).select("row_id", "action.action_type", "action.column", "action.value")


@query("sanitize_actions", f"""WITH {B.DECISIONS} SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'skip' ELSE action_type END AS action_type, CASE WHEN "column" IN ('id', 'age', 'name') THEN "column" ELSE 'id' END AS "column" FROM decisions""")
def sanitize_actions(spark, sf):
    d = B.decisions(spark, sf, steps=False)
    a = F.struct(F.when(F.col("row_id") % 5 != 0, F.col("action_type")).alias("action_type"), F.col("column"), F.lit(None).cast("string").alias("value"))
    return D.sanitize_actions(d.select("row_id", a.alias("action")), ["id", "age", "name"]).select("row_id", "action.action_type", "action.column")


@query("decision_accuracy", f"""WITH {B.DIRTY}, {CANDIDATES}, {_choose('0.0::DOUBLE')}, e AS (SELECT row_id, {SQL_EXPECTED} AS expected FROM found),
  j AS (SELECT row_id % 20 AS episode, action_type = expected AS ok FROM best JOIN e USING (row_id) WHERE rn = 1)
  SELECT episode, count(*) AS decisions, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy FROM j GROUP BY episode""")
def decision_accuracy_query(spark, sf):
    d = D.choose_action(candidates(spark, sf)).select(
        (F.col("row_id") % 20).alias("episode"), F.col("decision.action_type").alias("action_type"), expected_action(F.col("issues")).alias("expected"))
    return decision_accuracy(d).withColumn("accuracy", F.round("accuracy", 6))


@query("decide_fuzzy", f"""WITH {B.DIRTY}, {FUZZY_CANDIDATES}, {_choose('0.0::DOUBLE')}
  SELECT row_id, agent, action_type, col AS "column", value, round(score, 6) AS score FROM best WHERE rn = 1""")
def decide_fuzzy(spark, sf):
    d = decide(B.dirty(spark, sf).drop("truth"))
    return d.select("row_id", "decision.agent", "decision.action_type", "decision.column", "decision.value", F.round("decision.score", 6).alias("score"))
