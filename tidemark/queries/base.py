"""Tables the queries run on, derived from the given ones, in Spark and as SQL common table expressions.

The given tables have no missing cells and no duplicates, so a people table is derived from ``customer``
and made dirty by the hash-driven injectors; decisions come from ``events``, jobs from ``orders``, audit
rows and benchmark results from ``lineitem``, runs from ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import vocab
from tidemark.functions.scalars import gate, labels
from tidemark.operators.inject import make_dirty
from tidemark.operators.segments import with_rank

SEED = "42"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_hash(*parts: str) -> str:
    """SQL of the 32-bit hash; parts are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_gate(rate: float, op: str, column: str, key: str = "row_id") -> str:
    h = sql_hash(f"'{SEED}'", f"'{op}'", f"'{column}'", f"{key}::VARCHAR")
    return f"(({h}) / 4294967296.0::DOUBLE < {rate!r}::DOUBLE)"


def sql_pick(options: list, op: str, column: str, key: str = "row_id") -> str:
    h = sql_hash(f"'{SEED}'", f"'{op}'", f"'{column}'", f"{key}::VARCHAR")
    return f"([{', '.join(repr(o) for o in options)}])[(({h}) % {len(options)})::INT + 1]"


def sql_list(*pairs: tuple[str, str]) -> str:
    """List of the labels whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for cond, label in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sql_values(name: str, rows: dict) -> str:
    body = ", ".join(f"('{k}', '{v}')" for k, v in rows.items())
    return f"{name}(value, canonical) AS (VALUES {body})"


# --- people ---------------------------------------------------------------------------------
SEGMENT_DEPT = {"AUTOMOBILE": "engineering", "BUILDING": "sales", "FURNITURE": "marketing", "HOUSEHOLD": "hr",
                "MACHINERY": "finance"}


def people(spark: SparkSession, sf: str) -> DataFrame:
    return people_of(table(spark, sf, "customer"))


def people_of(c: DataFrame) -> DataFrame:
    dept = F.create_map(*[F.lit(x) for kv in SEGMENT_DEPT.items() for x in kv])
    domains = F.array(*[F.lit(d) for d in vocab.EMAIL_DOMAINS])
    return c.select(
        F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        (18 + F.pmod(F.col("c_custkey") * 37, F.lit(53))).cast("bigint").alias("age"),
        (40000 + F.floor((F.col("c_acctbal") + 1000) * 9)).cast("bigint").alias("salary"),
        F.pmod(F.col("c_custkey") * 13, F.lit(101)).cast("string").alias("score"),
        dept[F.col("c_mktsegment")].alias("dept"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"),
                 F.get(domains, F.pmod("c_nationkey", F.lit(4)))).alias("email"))


def dirty(spark: SparkSession, sf: str, level: str = "hard") -> DataFrame:
    return make_dirty(people(spark, sf), level)


_dept_case = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_DEPT.items()) + " END"
_domain_case = "CASE c_nationkey % 4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(vocab.EMAIL_DOMAINS)) + " END"
PEOPLE = f"""people AS (
  SELECT c_custkey AS row_id, c_custkey AS id, c_name AS name, (18 + (c_custkey * 37) % 53)::BIGINT AS age,
    (40000 + floor((c_acctbal + 1000) * 9))::BIGINT AS salary, ((c_custkey * 13) % 101)::VARCHAR AS score,
    {_dept_case} AS dept, lower(replace(c_name, '#', '.')) || '@' || {_domain_case} AS email
  FROM customer)"""


def sql_dirty(level: str, source: str = "people", key: str = "row_id", extra: str = "", duplicates: bool = True, episodes: str = "") -> str:
    """The injections of a level as a chain of CTEs ending in ``dirty``; ``episodes`` selects the duplicates from ``m0`` in place of the usual ones."""
    r = vocab.DIRT_LEVELS[level]

    def g(rate, op, col):
        return sql_gate(rate, op, col, key)

    def hit(rate, op, col):
        return f"({g(rate, op, col)} AND {col} IS NOT NULL)"

    lead = f"row_id, {extra}id"
    m = r["missing"] * 0.5
    ctes = [f"""m0 AS (SELECT {lead}, {', '.join(f"CASE WHEN {hit(m, 'missing', c)} THEN NULL ELSE {c} END AS {c}" for c in ('name', 'age', 'salary', 'score'))},
      dept, CASE WHEN {hit(m, 'missing', 'email')} THEN NULL ELSE email END AS email,
      {sql_list(*[(hit(m, 'missing', c), f'missing:{c}') for c in vocab.NULLABLE_COLUMNS])} AS truth FROM {source})"""]
    last = "m0"
    if episodes:
        ctes.append(f"m1 AS (SELECT * FROM m0 UNION ALL {episodes})")
        last = "m1"
    elif r["duplicate"] and duplicates:
        ctes.append(f"""m1 AS (SELECT * FROM m0 UNION ALL
      SELECT row_id + (SELECT power(10, length(max(row_id)::VARCHAR))::BIGINT FROM m0), id,
        CASE WHEN {g(0.3, 'lower', 'name')} THEN lower(name) ELSE name END, age, salary, score, dept, email,
        list_append(truth, 'duplicate:row') FROM m0 WHERE {g(r['duplicate'], 'duplicate', 'row')})""")
        last = "m1"
    if r["outlier"]:
        o = r["outlier"] * 0.3
        cell = {c: f"CASE WHEN {g(o, 'outlier', c)} THEN ({sql_pick(v, 'outlier_value', c, key)})::{'VARCHAR' if c == 'score' else 'BIGINT'} ELSE {c} END AS {c}"
                for c, v in vocab.OUTLIER_VALUES.items()}
        ctes.append(f"""m2 AS (SELECT {lead}, name, {cell['age']}, {cell['salary']}, {cell['score']}, dept, email,
      list_concat(truth, {sql_list(*[(g(o, 'outlier', c), f'outlier:{c}') for c in vocab.OUTLIER_VALUES])}) AS truth FROM {last})""")
        last = "m2"
    if r["category"]:
        k = r["category"] * 0.5
        typo = "CASE dept " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vocab.DEPT_TYPOS.items()) + " ELSE dept || 'x' END"
        ctes.append(f"""m3 AS (SELECT {lead},
      CASE WHEN {hit(k, 'category', 'name')} THEN CASE WHEN {g(0.5, 'upper', 'name')} THEN upper(name) ELSE lower(name) END ELSE name END AS name,
      age, salary, score, CASE WHEN {hit(k, 'category', 'dept')} THEN {typo} ELSE dept END AS dept, email,
      list_concat(truth, {sql_list((hit(k, 'category', 'dept'), 'category:dept'), (hit(k, 'category', 'name'), 'category:name'))}) AS truth FROM {last})""")
        last = "m3"
    t = r["type"]
    ctes.append(f"""m4 AS (SELECT {lead}, name, age, salary, CASE WHEN {hit(t, 'type', 'score')} THEN score || ' points' ELSE score END AS score,
      dept, email, list_concat(truth, {sql_list((hit(t, 'type', 'score'), 'wrong_type:score'))}) AS truth FROM {last})""")
    last = "m4"
    if r["formatting"]:
        f = r["formatting"] * 0.5
        ctes.append(f"""m5 AS (SELECT {lead},
      CASE WHEN {hit(f, 'formatting', 'name')} THEN CASE WHEN {g(0.5, 'padded', 'name')} THEN name || ' ' ELSE replace(name, ' ', '_') END ELSE name END AS name,
      age, salary, score, dept,
      CASE WHEN {hit(f, 'formatting', 'email')} AND contains(email, '@') THEN CASE WHEN {g(0.5, 'spelled', 'email')} THEN replace(email, '@', ' at ') ELSE email || '.com' END ELSE email END AS email,
      list_concat(truth, {sql_list((hit(f, 'formatting', 'email'), 'formatting:email'), (hit(f, 'formatting', 'name'), 'formatting:name'))}) AS truth FROM {last})""")
        last = "m5"
    ctes.append(f"dirty AS (SELECT * FROM {last})")
    return ",\n".join(ctes)


DIRTY = PEOPLE + ",\n" + sql_dirty("hard")
DIRTY_MEDIUM = PEOPLE + ",\n" + sql_dirty("medium")
DIRTY_EASY = PEOPLE + ",\n" + sql_dirty("easy")

# what Python's float() takes, written for RE2
SQL_NUMERIC = (r"^\s*[+-]?((([0-9]+(_[0-9]+)*)([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?"
               r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")


def sql_numeric(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{SQL_NUMERIC}'), false)"


def sql_number(c: str) -> str:
    return f"CASE WHEN {sql_numeric(c)} THEN try_cast(replace(trim({c}), '_', '') AS DOUBLE) END"


SQL_DUP = "row_id NOT IN (SELECT min(row_id) FROM dirty GROUP BY name, email)"
KNOWN_DEPTS = ", ".join(f"'{d}'" for d in vocab.DEPT_OPTIONS)
PEOPLE_ISSUES = [
    *[(f"{c} IS NULL", f"missing:{c}") for c in vocab.NULLABLE_COLUMNS],
    (f"score IS NOT NULL AND NOT {sql_numeric('score')}", "wrong_type:score"),
    ("email IS NOT NULL AND (NOT contains(email, '@') OR contains(email, ' at '))", "formatting:email"),
    ("name IS NOT NULL AND (contains(name, '  ') OR contains(name, '_'))", "formatting:name"),
    (f"dept IS NOT NULL AND dept NOT IN ({KNOWN_DEPTS})", "category:dept"),
]


def _outside(v: str, c: str) -> str:
    q1, q3 = vocab.TYPICAL_QUARTILES[c]
    return f"({v} < {q1 - 1.5 * (q3 - q1)} OR {v} > {q3 + 1.5 * (q3 - q1)})"


OUTLIER_ISSUES = [(_outside("age", "age"), "outlier:age"), (_outside("salary", "salary"), "outlier:salary"),
                  (_outside(f"({sql_number('score')})", "score"), "outlier:score")]
ISSUES = f"found AS (SELECT *, {sql_list(*PEOPLE_ISSUES)} AS issues FROM dirty)"
# issues with outliers and, for rows with an earlier equal (name, email), the duplicate mark
ALL_ISSUES = f"""firsts AS (SELECT min(row_id) AS first_id FROM dirty GROUP BY name, email),
found AS (SELECT dirty.*, list_concat({sql_list(*PEOPLE_ISSUES, *OUTLIER_ISSUES)},
    CASE WHEN first_id IS NULL THEN ['duplicate:row'] ELSE [] END) AS issues
  FROM dirty LEFT JOIN firsts ON row_id = first_id)"""


def sql_any(issues: str, prefix: str) -> str:
    return f"len(list_filter({issues}, lambda x: starts_with(x, '{prefix}'))) > 0"


def sql_has(issues: str, part: str) -> str:
    return f"len(list_filter({issues}, lambda x: contains(x, '{part}'))) > 0"


def sql_count(issues: str, *parts: str) -> str:
    cond = " OR ".join(f"contains(x, '{p}')" for p in parts)
    return f"len(list_filter({issues}, lambda x: {cond}))"


# --- decisions ------------------------------------------------------------------------------
EVENT_ACTION = {"view": "fill_missing", "click": "fix_category", "error": "skip", "signup": "remove_duplicate",
                "purchase": "remove_outlier"}
ACTION_AGENT = {"fill_missing": "FillMissingAgent", "fix_category": "CategoryStandardizer", "skip": "SkipAgent",
                "remove_duplicate": "DuplicateDetector", "remove_outlier": "OutlierHandler"}
DECISION_COLUMNS = ["age", "salary", "name", "dept"]
DECISION_ISSUES = [(0.4, "missing:age"), (0.2, "duplicate:row"), (0.2, "outlier:salary"), (0.3, "category:dept"),
                   (0.3, "formatting:email"), (0.1, "wrong_type:score")]


def decisions(spark: SparkSession, sf: str, steps: bool = True) -> DataFrame:
    d = decisions_of(table(spark, sf, "events"))
    return with_rank(d, ["episode"], "row_id", name="step") if steps else d


def decisions_of(e: DataFrame) -> DataFrame:
    action = F.create_map(*[F.lit(x) for kv in EVENT_ACTION.items() for x in kv])
    agent = F.create_map(*[F.lit(x) for kv in ACTION_AGENT.items() for x in kv])
    issues = labels([(gate(r, F.lit(SEED), F.lit("issue"), F.lit(i), F.col("event_id")), i) for r, i in DECISION_ISSUES])
    return e.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("episode"), F.col("ts"),
        action[F.col("event_type")].alias("action_type"), agent[action[F.col("event_type")]].alias("agent"),
        F.get(F.array(*[F.lit(c) for c in DECISION_COLUMNS]), F.pmod("event_id", F.lit(4)).cast("int")).alias("column"),
        F.round((F.col("value") - 50) / 100, 4).alias("reward"),
        (F.pmod(F.col("event_id") * 7, F.lit(100)) / 100.0).alias("confidence"), issues.alias("issues"))


_act_case = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ACTION.items()) + " END"
_agent_case = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{ACTION_AGENT[v]}'" for k, v in EVENT_ACTION.items()) + " END"
_issue_list = sql_list(*[(sql_gate(r, "issue", i, "event_id"), i) for r, i in DECISION_ISSUES])
DECISIONS = f"""decisions AS (
  SELECT event_id AS row_id, user_id AS episode, ts, {_act_case} AS action_type, {_agent_case} AS agent,
    (['age', 'salary', 'name', 'dept'])[(event_id % 4)::INT + 1] AS "column", round((value - 50) / 100, 4) AS reward,
    ((event_id * 7) % 100) / 100.0::DOUBLE AS confidence, {_issue_list} AS issues,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step
  FROM events)"""


# --- jobs, audit rows, runs, benchmark results --------------------------------------------------
def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = (F.when(k % 10 == 0, "failed").when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "P", "processing").otherwise("queued"))
    d = o.select(
        k.alias("job_id"), F.col("o_custkey").alias("dataset_id"), status.alias("status"),
        F.when(k % 2 == 0, "batch").otherwise("interactive").alias("job_type"), F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").cast("bigint").alias("total_rows"))
    start = F.col("created_at") + F.make_dt_interval(secs=F.pmod("job_id", F.lit(86400)))
    d = d.withColumn("started_at", F.when(F.col("status") != "queued", start))
    done = F.col("status") == "completed"
    return d.withColumns({
        "completed_at": F.when(done, F.col("started_at") + F.make_dt_interval(secs=F.pmod(F.col("job_id") * 7, F.lit(20000)))),
        "rows_processed": F.when(done, F.col("total_rows")).when(
            F.col("status") == "processing", F.floor(F.col("total_rows") * F.pmod("job_id", F.lit(100)) / 100)).otherwise(0).cast("bigint"),
        "result_score": F.when(done, F.pmod(F.col("job_id") * 31, F.lit(1000)) / 1000.0),
    })


JOBS = """jobs0 AS (
  SELECT o_orderkey AS job_id, o_custkey AS dataset_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'queued' END AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN 'batch' ELSE 'interactive' END AS job_type, o_orderdate AS created_at,
    floor(o_totalprice)::BIGINT AS total_rows FROM orders),
jobs1 AS (SELECT *, CASE WHEN status <> 'queued' THEN created_at + to_seconds(job_id % 86400) END AS started_at FROM jobs0),
jobs AS (SELECT *, CASE WHEN status = 'completed' THEN started_at + to_seconds((job_id * 7) % 20000) END AS completed_at,
    CASE WHEN status = 'completed' THEN total_rows WHEN status = 'processing' THEN floor(total_rows * (job_id % 100) / 100)::BIGINT ELSE 0 END::BIGINT AS rows_processed,
    CASE WHEN status = 'completed' THEN ((job_id * 31) % 1000) / 1000.0::DOUBLE END AS result_score FROM jobs1)"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_of(table(spark, sf, "lineitem"))


def audit_of(l: DataFrame) -> DataFrame:
    action = F.when(F.col("l_returnflag") == "A", "fill_missing").when(F.col("l_returnflag") == "N", "fix_category").otherwise("skip")
    agent = F.when(F.col("l_returnflag") == "A", "FillMissingAgent").when(F.col("l_returnflag") == "N", "CategoryStandardizer").otherwise("SkipAgent")
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("job_id"),
        action.alias("action_type"), F.col("l_linenumber").cast("bigint").alias("row_index"),
        F.when(F.col("l_linestatus") == "F", "email").otherwise("dept").alias("column"),
        F.round(F.col("l_discount") - 0.05, 2).alias("reward"), agent.alias("agent_used"),
        F.round(1 - F.col("l_tax") * 6, 2).alias("confidence"), F.col("l_shipdate").alias("timestamp"))


AUDIT = """audit AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS job_id,
    CASE l_returnflag WHEN 'A' THEN 'fill_missing' WHEN 'N' THEN 'fix_category' ELSE 'skip' END AS action_type,
    l_linenumber::BIGINT AS row_index, CASE l_linestatus WHEN 'F' THEN 'email' ELSE 'dept' END AS "column",
    round(l_discount - 0.05, 2) AS reward,
    CASE l_returnflag WHEN 'A' THEN 'FillMissingAgent' WHEN 'N' THEN 'CategoryStandardizer' ELSE 'SkipAgent' END AS agent_used,
    round(1 - l_tax * 6, 2) AS confidence, l_shipdate AS "timestamp" FROM lineitem)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    level = F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.pmod("p_size", F.lit(3)))
    return p.select(
        F.concat(F.lit("v"), k.cast("string")).alias("version"),
        F.concat(F.lit("t"), F.lpad(F.pmod(k * 7919, F.lit(1000003)).cast("string"), 7, "0")).alias("timestamp"),
        level.alias("difficulty"), (F.col("p_size") * 10).cast("bigint").alias("epochs"),
        (F.col("p_retailprice") / 100).alias("final_reward"),
        (F.col("p_retailprice") / 100 + F.col("p_size")).alias("best_reward"),
        (k * 1024 + F.col("p_size")).cast("bigint").alias("file_size"))


RUNS = """runs AS (
  SELECT 'v' || p_partkey AS version, 't' || lpad(((p_partkey * 7919) % 1000003)::VARCHAR, 7, '0') AS "timestamp",
    (['easy', 'medium', 'hard'])[(p_size % 3)::INT + 1] AS difficulty, (p_size * 10)::BIGINT AS epochs,
    p_retailprice / 100 AS final_reward, p_retailprice / 100 + p_size AS best_reward,
    (p_partkey * 1024 + p_size)::BIGINT AS file_size FROM part)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark results: one row per line item."""
    l = table(spark, sf, "lineitem")
    approach = F.when(F.col("l_returnflag") == "A", "DQN").when(F.col("l_returnflag") == "N", "Specialist").otherwise("LLM")
    level = F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.pmod("l_linenumber", F.lit(3)))
    ms = F.col("l_quantity") * F.when(F.col("l_returnflag") == "R", 40.0).otherwise(0.1)
    return l.select(
        approach.alias("approach"), level.alias("difficulty"), (100 - F.col("l_discount") * 100).alias("accuracy"),
        ms.alias("avg_speed_ms"), (100 - F.col("l_tax") * 50).alias("consistency_score"), F.col("l_orderkey").alias("episode"),
        F.when(F.col("l_discount") > 0.03, "fill_missing").otherwise("skip").alias("action_type"),
        F.when(F.col("l_tax") > 0.02, "fill_missing").otherwise("skip").alias("expected"))


RESULTS = """results AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'DQN' WHEN 'N' THEN 'Specialist' ELSE 'LLM' END AS approach,
    (['easy', 'medium', 'hard'])[(l_linenumber % 3)::INT + 1] AS difficulty, 100 - l_discount * 100 AS accuracy,
    l_quantity * CASE l_returnflag WHEN 'R' THEN 40.0::DOUBLE ELSE 0.1::DOUBLE END AS avg_speed_ms,
    100 - l_tax * 50 AS consistency_score, l_orderkey AS episode,
    CASE WHEN l_discount > 0.03 THEN 'fill_missing' ELSE 'skip' END AS action_type,
    CASE WHEN l_tax > 0.02 THEN 'fill_missing' ELSE 'skip' END AS expected FROM lineitem)"""
