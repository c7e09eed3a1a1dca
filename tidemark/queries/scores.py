"""Profiles, quality scores, grading, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.operators import clean as C
from tidemark.operators import grading as G
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.plans.cleaning import clean
from tidemark.queries import base as B
from tidemark.queries.registry import query
from tidemark.queries.repair import SQL_CLEAN_HARD, SQL_FILLED, WS

COLS = ["id", "name", "age", "salary", "score", "dept", "email"]


def sql_blank(c):
    return f"({c} IS NULL OR trim({c}::VARCHAR) = '')"


@query("missing_profile", f"""WITH {B.DIRTY}, m AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({sql_blank(c)}) AS {c}' for c in COLS)} FROM dirty)
  {' UNION ALL '.join(f"SELECT '{c}' AS " + '"column"' + f", {c} AS missing, round({c} / greatest(n, 1)::DOUBLE, 6) AS missing_pct FROM m" for c in COLS)}
  UNION ALL SELECT '*', {' + '.join(COLS)}, round(({' + '.join(COLS)}) / greatest(n * 7, 1)::DOUBLE, 6) FROM m""")
def missing_profile(spark, sf):
    return Q.missing_profile(B.dirty(spark, sf).drop("truth")).withColumn("missing_pct", F.round("missing_pct", 6))


@query("duplicate_count", f"""WITH {B.DIRTY_MEDIUM}, g AS (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(COLS)}) SELECT sum(n - 1)::BIGINT AS duplicates FROM g""")
def duplicate_count(spark, sf):
    return Q.duplicate_count(B.dirty(spark, sf, "medium").drop("truth"))


def sql_quality(source, cols=COLS):
    return (f"(SELECT sum(n)::BIGINT AS \"rows\", sum(n * gaps)::BIGINT AS missing, sum(n - 1)::BIGINT AS duplicates FROM "
            f"(SELECT count(*) AS n, any_value({' + '.join(f'{sql_blank(c)}::INT' for c in cols)}) AS gaps FROM {source} GROUP BY {', '.join(cols)}))")


def sql_score(n=7):
    return f'greatest(0, least(1, 1.0::DOUBLE - missing / greatest("rows" * {n}, 1)::DOUBLE - duplicates / greatest("rows", 1)::DOUBLE))'


@query("quality_score", f"""WITH {B.DIRTY_MEDIUM} SELECT "rows", missing, round(missing / ("rows" * 7)::DOUBLE, 6) AS missing_pct, duplicates, round({sql_score()}, 6) AS quality_score FROM {sql_quality('dirty')}""")
def quality_score(spark, sf):
    return Q.quality(B.dirty(spark, sf, "medium").drop("truth"))


@query("quality_score_lineitem", """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY ALL) SELECT 0::BIGINT AS missing, 0.0::DOUBLE AS missing_pct, (SELECT count(*) FROM lineitem) AS "rows",
    (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates,
    round(1 - ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS quality_score""")
def quality_score_lineitem(spark, sf):
    return Q.quality(B.table(spark, sf, "lineitem"), skip=())


@query("profile", f"""WITH {B.DIRTY}, c AS (
    {' UNION ALL '.join(f"SELECT '{c}' AS " + '"column"' + f", '{t}' AS type, {c}::VARCHAR AS v, {c + '::DOUBLE' if t == 'bigint' else 'NULL::DOUBLE'} AS x FROM dirty" for c, t in (('id', 'bigint'), ('name', 'string'), ('age', 'bigint'), ('salary', 'bigint'), ('score', 'string'), ('dept', 'string'), ('email', 'string')))}),
  s AS (SELECT "column", type, count(*) AS "rows", count(*) FILTER (v IS NULL OR trim(v) = '') AS missing, count(DISTINCT v) AS "distinct", min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max FROM c GROUP BY 1, 2)
  SELECT s."column", s.type, "rows", missing, "distinct", min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, max,
    CASE WHEN s.type = 'bigint' THEN (SELECT count(*) FROM c WHERE c."column" = s."column" AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) END AS outliers FROM s""")
def profile(spark, sf):
    p = Q.profile(B.dirty(spark, sf).drop("truth"))
    return p.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("profile_approximate")
def profile_approximate(spark, sf):
    return Q.profile(B.table(spark, sf, "lineitem"), approximate=True)


@query("compare_quality", f"""WITH {B.DIRTY}, {SQL_CLEAN_HARD}, b AS (SELECT *, round({sql_score()}, 6) AS s FROM {sql_quality('dirty')}),
  a AS (SELECT *, round({sql_score()}, 6) AS s FROM {sql_quality('cleaned')}), u AS (SELECT 'original' AS phase, b.* FROM b UNION ALL SELECT 'cleaned', a.* FROM a)
  SELECT phase, "rows", round(missing / ("rows" * 7)::DOUBLE, 6) AS missing_pct, duplicates, s AS quality_score,
    round(greatest(0, least(1, (SELECT s FROM a) - (SELECT s FROM b))), 6) AS improvement FROM u""")
def compare_quality(spark, sf):
    d = B.dirty(spark, sf).drop("truth")
    return Q.compare_quality(d, clean(d, "hard"))


@query("projected_metrics", f"""WITH {B.DIRTY_MEDIUM}, b AS (SELECT *, {sql_score()} AS s FROM {sql_quality('dirty')})
  SELECT round(missing / ("rows" * 7)::DOUBLE * 0.35::DOUBLE, 6) AS missing_pct, floor(duplicates * 0.2::DOUBLE)::BIGINT AS duplicates, round(least(1, s + 0.25::DOUBLE), 6) AS quality_score,
    round(greatest(0, least(1, least(1, s + 0.25::DOUBLE) - s)), 6) AS improvement FROM b""")
def projected_metrics(spark, sf):
    return Q.projected_metrics(B.dirty(spark, sf, "medium").drop("truth"))


# --- grading ------------------------------------------------------------------------------------
SQL_EASY = "(count(age) + count(salary) + count(score) + count(*) FILTER ({num}))".format(num=B.sql_numeric("score::VARCHAR"))


@query("grade_easy", f"""WITH {B.DIRTY_EASY} SELECT {SQL_EASY}::BIGINT AS passed, (count(*) * 4)::BIGINT AS total, round({SQL_EASY} / (count(*) * 4)::DOUBLE, 2) AS score FROM dirty""")
def grade_easy(spark, sf):
    return G.grade(B.dirty(spark, sf, "easy"), "easy")


SQL_MEDIUM = "((count(*) = count(DISTINCT coalesce(lower(email), '')))::INT + count(name) + count(age) + count(*) FILTER (coalesce(email, '') = lower(coalesce(email, ''))))"


@query("grade_medium", f"""WITH {B.DIRTY_MEDIUM} SELECT {SQL_MEDIUM}::BIGINT AS passed, (count(*) * 3 + 1)::BIGINT AS total, round({SQL_MEDIUM} / (count(*) * 3 + 1)::DOUBLE, 2) AS score FROM dirty""")
def grade_medium(spark, sf):
    return G.grade(B.dirty(spark, sf, "medium"), "medium")


SQL_HARD = "((count(*) = count(DISTINCT name) + max((name IS NULL)::INT))::INT + count(name) + count(age) + count(salary) + count(*) FILTER (dept IN ('Engineering', 'HR', 'Finance')) + count(*) FILTER (salary > 0 AND salary < 200000))"


@query("grade_hard", f"""WITH {B.DIRTY}, {SQL_CLEAN_HARD}, u AS (SELECT 'dirty' AS t, name, age, salary, dept FROM dirty UNION ALL SELECT 'cleaned', name, age, salary, dept FROM cleaned)
  SELECT t AS "table", {SQL_HARD}::BIGINT AS passed, (count(*) * 5 + 1)::BIGINT AS total, round({SQL_HARD} / (count(*) * 5 + 1)::DOUBLE, 2) AS score FROM u GROUP BY t""")
def grade_hard(spark, sf):
    d = B.dirty(spark, sf)
    return G.grade(d, "hard").withColumn("table", F.lit("dirty")).unionByName(G.grade(clean(d, "hard"), "hard").withColumn("table", F.lit("cleaned")))


@query("check_suite", f"""WITH {B.DIRTY}, s AS (SELECT count(*) AS n, count(*) FILTER (age BETWEEN 18 AND 70) AS a, count(*) FILTER (contains(email, '@')) AS e, (count(*) = count(DISTINCT email) + max((email IS NULL)::INT))::BIGINT AS u FROM dirty),
  r AS (SELECT 'adult' AS "check", a AS passed, n AS total FROM s UNION ALL SELECT 'email_at', e, n FROM s UNION ALL SELECT 'email_unique', u, 1 FROM s UNION ALL SELECT '*', a + e + u, n * 2 + 1 FROM s)
  SELECT "check", passed, total::BIGINT AS total, round(passed / total::DOUBLE, 2) AS score FROM r""")
def check_suite(spark, sf):
    return G.check_suite(B.dirty(spark, sf), [
        G.Check("adult", F.col("age").between(18, 70)), G.Check("email_at", F.col("email").contains("@")),
        G.Check("email_unique", G.all_distinct(F.col("email")), "table")])


@query("distinct_count_check", f"""WITH {B.DIRTY} SELECT count(*) AS "rows", count(DISTINCT name) AS "values", count(*) = count(DISTINCT name) + max((name IS NULL)::INT) AS all_distinct FROM dirty""")
def distinct_count_check(spark, sf):
    return G.distinct_count_check(B.dirty(spark, sf), "name")


@query("task_success", f"""WITH {B.JOBS} SELECT job_id, CASE WHEN result_score IS NOT NULL THEN greatest(0, least(1, result_score * 1.2::DOUBLE - 0.1::DOUBLE)) END AS score, coalesce(result_score * 1.2::DOUBLE - 0.1::DOUBLE >= 0.5, false) AS success FROM jobs""")
def task_success(spark, sf):
    j = B.jobs(spark, sf).select("job_id", (F.col("result_score") * 1.2 - 0.1).alias("score"))
    return G.task_success(j)


@query("mean_score", f"""WITH {B.JOBS} SELECT round(avg(greatest(0, least(1, result_score * 1.2::DOUBLE - 0.1::DOUBLE))) FILTER (result_score IS NOT NULL), 6) AS mean_score, count(*) AS tasks, count(result_score) AS scored FROM jobs""")
def mean_score(spark, sf):
    j = B.jobs(spark, sf).select((F.col("result_score") * 1.2 - 0.1).alias("score"))
    return G.mean_score(j).withColumn("mean_score", F.round("mean_score", 6))


# --- scalar functions ---------------------------------------------------------------------------
@query("text_functions", """SELECT doc_id, lower(source) AS low, upper(lang) AS up, length(trim(text)) AS trimmed_length, md5(trim(text)) AS trimmed_md5, replace(source, 'src', 'source ') AS named, contains(text, 'the') AS has_the,
  starts_with(text, 'T') AS starts_t, split_part(text, ' ', 1) AS first_word, concat(lang, ':', source) AS tag, format('{}#{}', lang, doc_id) AS label FROM documents""")
def text_functions(spark, sf):
    t = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id", F.lower("source").alias("low"), F.upper("lang").alias("up"), F.length(F.trim(t)).cast("bigint").alias("trimmed_length"), F.md5(F.trim(t).cast("binary")).alias("trimmed_md5"),
        F.replace("source", F.lit("src"), F.lit("source ")).alias("named"), t.contains("the").alias("has_the"), t.startswith("T").alias("starts_t"),
        F.split_part(t, F.lit(" "), F.lit(1)).alias("first_word"), F.concat("lang", F.lit(":"), "source").alias("tag"),
        F.format_string("%s#%d", "lang", "doc_id").alias("label"))


@query("float_parse", f"""WITH {B.DIRTY} SELECT row_id, {B.sql_number('score')} AS score, {B.sql_numeric('score')} AS is_number FROM dirty""")
def float_parse(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.parse_number(F.col("score")).alias("score"), P.numeric_text(F.col("score")).alias("is_number"))


@query("number_functions", """SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS clamped, abs(c_acctbal) AS magnitude, round(pow(abs(c_acctbal), 0.6::DOUBLE), 6) AS powered,
  floor(c_acctbal)::BIGINT AS down, ceil(c_acctbal)::BIGINT AS up, round(c_acctbal / 7, 2) AS r2, round(c_acctbal / 7, 3) AS r3, round(c_acctbal / 7, 6) AS r6 FROM customer""")
def number_functions(spark, sf):
    a = F.col("c_acctbal")
    return B.table(spark, sf, "customer").select(
        "c_custkey", S.clamp(a / 5000).alias("clamped"), F.abs(a).alias("magnitude"), F.round(F.pow(F.abs(a), F.lit(0.6)), 6).alias("powered"),
        F.floor(a).alias("down"), F.ceil(a).alias("up"), *[F.round(a / 7, n).alias(f"r{n}") for n in (2, 3, 6)])


@query("number_statistics", """SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""")
def number_statistics(spark, sf):
    from tidemark.operators.quantiles import quantile_struct
    from tidemark.operators.segments import null_safe

    o = B.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    flat = o.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))
    q = quantile_struct(o, ["o_totalprice"], [0.25, 0.5, 0.75], by=["o_orderstatus"])
    out = null_safe(flat, q, ["o_orderstatus"], "inner").withColumnsRenamed(
        {"o_totalprice_q0": "q1", "o_totalprice_q1": "median", "o_totalprice_q2": "q3"})
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


@query("elapsed_time", f"""WITH {B.JOBS}, e AS (SELECT job_id, floor(date_diff('second', started_at, completed_at) / 60)::BIGINT AS m FROM jobs)
  SELECT job_id, CASE WHEN m >= 60 THEN (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm' ELSE m::VARCHAR || 'm' END AS elapsed FROM e""")
def elapsed_time(spark, sf):
    j = B.jobs(spark, sf)
    return j.select("job_id", S.elapsed_text(F.col("started_at"), F.col("completed_at")).alias("elapsed"))


@query("eta", f"""WITH {B.JOBS}, e AS (SELECT job_id, CASE WHEN rows_processed > 0 THEN ceil((total_rows - rows_processed) * 3600 / (rows_processed * 60.0::DOUBLE))::BIGINT END AS m FROM jobs WHERE status = 'processing')
  SELECT job_id, m AS minutes, CASE WHEN m IS NULL THEN 'Calculating...' WHEN m > 60 THEN '~' || (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm' ELSE '~' || m::VARCHAR || 'm' END AS eta FROM e""")
def eta(spark, sf):
    j = B.jobs(spark, sf).filter("status = 'processing'")
    now = F.col("started_at") + F.make_dt_interval(secs=F.lit(3600))
    m = S.eta_minutes(F.col("started_at"), now, F.col("rows_processed"), F.col("total_rows"))
    return j.select("job_id", m.alias("minutes"), S.eta_text(m).alias("eta"))


@query("human_size", """WITH s AS (SELECT o_orderkey, (o_orderkey * o_orderkey * (o_orderkey % 23) + o_orderkey)::BIGINT AS b FROM orders)
  SELECT o_orderkey, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN printf('%.1f', round(b / 1024.0::DOUBLE, 1)) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', round(b / 1048576.0::DOUBLE, 1)) || ' MB' ELSE printf('%.1f', round(b / 1073741824.0::DOUBLE, 1)) || ' GB' END AS size FROM s""")
def human_size(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select("o_orderkey", S.human_size(k * k * (k % 23) + k).alias("size"))


@query("json_codec", """WITH j AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'not json {' ELSE props END AS p FROM events)
  SELECT event_id, CASE WHEN json_valid(p) THEN (p ->> '$.k')::BIGINT END AS k, '{"id":' || event_id::VARCHAR || ',"type":"x"}' AS encoded FROM j""")
def json_codec(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "not json {").otherwise(F.col("props")).alias("p"))
    return e.select("event_id", S.json_field(F.col("p"), "k bigint")["k"].alias("k"),
                    F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("x").alias("type"))).alias("encoded"))


@query("array_functions", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, len(issues)::INT AS n, list_contains(issues, 'missing:age') AS has_age, issues[1] AS first_issue,
  len(list_distinct(list_transform(issues, lambda x: split_part(x, ':', 1))))::INT AS kinds, {B.sql_any('issues', 'missing:')} AS any_missing FROM found""")
def array_functions(spark, sf):
    from tidemark.queries.detection import found

    i = F.col("issues")
    return found(spark, sf).select(
        "row_id", F.size(i).alias("n"), F.array_contains(i, "missing:age").alias("has_age"), F.get(i, F.lit(0)).alias("first_issue"),
        F.size(F.array_distinct(F.transform(i, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))).alias("kinds"),
        S.any_issue(i, prefix="missing:").alias("any_missing"))


@query("email_domain", f"""WITH {B.DIRTY} SELECT row_id, CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) END AS domain FROM dirty""")
def email_domain(spark, sf):
    return B.dirty(spark, sf).select("row_id", S.email_domain(F.col("email")).alias("domain"))


# --- sets ---------------------------------------------------------------------------------------
@query("union_runs", f"""WITH {B.RUNS} SELECT version, final_reward, NULL::BIGINT AS file_size FROM runs WHERE difficulty = 'easy' UNION ALL SELECT version, NULL::DOUBLE, file_size FROM runs WHERE difficulty <> 'easy'""")
def union_runs(spark, sf):
    r = B.runs(spark, sf)
    return J.union_runs(r.filter("difficulty = 'easy'").select("version", "final_reward"), r.filter("difficulty <> 'easy'").select("version", "file_size"))


@query("distinct_values", """SELECT DISTINCT p_brand FROM part""")
def distinct_values(spark, sf):
    return J.distinct_values(B.table(spark, sf, "part"), "p_brand")


@query("common_rows", """SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def common_rows(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_name")
    s = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name")
    return J.common_rows(c, s)


@query("unmatched_values", f"""WITH {B.DIRTY} SELECT DISTINCT dept FROM dirty WHERE dept NOT IN ({B.KNOWN_DEPTS})""")
def unmatched_values(spark, sf):
    known = spark.createDataFrame([(d,) for d in vocab.DEPT_OPTIONS], "dept string")
    return J.unmatched(B.dirty(spark, sf), "dept", known)


@query("scan_parquet", """SELECT * FROM nation""")
def scan_parquet(spark, sf):
    from tidemark.sources.files import scan

    return scan(spark, f"{sf}/nation.parquet")
