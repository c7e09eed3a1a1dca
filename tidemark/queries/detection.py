"""Issue detection and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.operators import detect as D
from tidemark.queries import base as B
from tidemark.queries.registry import query


def joined(c):
    return F.array_join(F.array_sort(c), ",")


SQL_JOINED = "array_to_string(list_sort({}), ',')"


def found(spark, sf, level="hard"):
    d = B.dirty(spark, sf, level)
    return D.detect_issues(d, D.people_rules(d))


def found_all(spark, sf):
    from tidemark.plans.cleaning import with_duplicate_issue

    d = B.dirty(spark, sf)
    return with_duplicate_issue(D.detect_issues(d, D.people_rules(d, outliers=True)), ["name", "email"])


PEOPLE_COLS = ["id", "name", "age", "salary", "score", "dept", "email"]


@query("missing_null", f"""WITH {B.DIRTY} SELECT row_id, age IS NULL AS age_missing, name IS NULL AS name_missing FROM dirty""")
def missing_null(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.missing(F.col("age"), "null").alias("age_missing"),
                                     P.missing(F.col("name"), "null").alias("name_missing"))


@query("missing_blank", """
  WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '  ' || chr(9) WHEN o_orderkey % 7 = 2 THEN NULL ELSE o_orderpriority END AS note,
    CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_totalprice END AS price FROM orders)
  SELECT o_orderkey, note IS NULL OR trim(note, ' ' || chr(9)) = '' AS note_missing, price IS NULL OR isnan(price) AS price_missing FROM b""")
def missing_blank(spark, sf):
    k = F.col("o_orderkey")
    b = B.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 7 == 0, "").when(k % 7 == 1, "  \t").when(k % 7 == 2, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("note"),
        F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"))
    return b.select("o_orderkey", P.missing(F.col("note"), "blank", b.schema["note"].dataType).alias("note_missing"),
                    P.missing(F.col("price"), "blank", b.schema["price"].dataType).alias("price_missing"))


@query("missing_named_columns", f"""WITH {B.DIRTY} SELECT row_id, {', '.join(f'{c} IS NULL AS {c}' for c in vocab.NULLABLE_COLUMNS)} FROM dirty""")
def missing_named_columns(spark, sf):
    d = B.dirty(spark, sf)
    return d.select("row_id", *[P.missing(F.col(c), "na", d.schema[c].dataType).alias(c) for c in vocab.NULLABLE_COLUMNS])


NUMBERISH_SQL = """numberish AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
    WHEN 1 THEN l_extendedprice::VARCHAR WHEN 2 THEN ' ' || l_partkey::VARCHAR || ' ' WHEN 3 THEN l_partkey::VARCHAR || 'd'
    WHEN 4 THEN '1_' || l_partkey::VARCHAR WHEN 5 THEN l_partkey::VARCHAR || ' points' WHEN 6 THEN l_suppkey::VARCHAR || 'e2' ELSE 'NaN' END AS t FROM lineitem)"""


def numberish(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(n == 1, F.col("l_extendedprice").cast("string")).when(n == 2, F.concat(F.lit(" "), p, F.lit(" ")))
        .when(n == 3, F.concat(p, F.lit("d"))).when(n == 4, F.concat(F.lit("1_"), p)).when(n == 5, F.concat(p, F.lit(" points")))
        .when(n == 6, F.concat(F.col("l_suppkey").cast("string"), F.lit("e2"))).otherwise("NaN").alias("t"))


@query("numeric_text", f"""WITH {NUMBERISH_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {B.sql_numeric('t')} AS wrong_type FROM numberish""")
def numeric_text(spark, sf):
    return numberish(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.numeric_text(F.col("t")).alias("wrong_type"))


@query("non_numeric_text", f"""WITH {B.DIRTY} SELECT row_id, score IS NOT NULL AND NOT {B.sql_numeric('score')} AS wrong_type FROM dirty""")
def non_numeric_text(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.non_numeric_text(F.col("score")).alias("wrong_type"))


@query("has_upper", """SELECT doc_id, coalesce(text <> lower(text), false) AS upper_text, coalesce(lang <> lower(lang), false) AS upper_lang FROM documents""")
def has_upper(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", P.has_upper(F.col("text")).alias("upper_text"), P.has_upper(F.col("lang")).alias("upper_lang"))


@query("bad_email", f"""WITH {B.DIRTY} SELECT row_id, coalesce(NOT contains(email, '@') OR contains(email, ' at '), false) AS bad FROM dirty""")
def bad_email(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.bad_email(F.col("email")).alias("bad"))


@query("bad_name", f"""WITH {B.DIRTY} SELECT row_id, coalesce(contains(name, '  ') OR contains(name, '_'), false) AS bad,
    coalesce(contains(name, '  ') OR contains(name, '_') OR name <> trim(name), false) AS bad_trim FROM dirty""")
def bad_name(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.bad_name(F.col("name")).alias("bad"), P.bad_name(F.col("name"), trim=True).alias("bad_trim"))


@query("unknown_category", f"""WITH {B.DIRTY} SELECT row_id, coalesce(dept NOT IN ({B.KNOWN_DEPTS}), false) AS unknown FROM dirty""")
def unknown_category(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.unknown_category(F.col("dept"), vocab.DEPT_OPTIONS).alias("unknown"))


@query("unknown_category_table", """SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 49 AND p_retailprice < 950)""")
def unknown_category_table(spark, sf):
    from tidemark.operators.joins import unmatched

    p = B.table(spark, sf, "part")
    return unmatched(p, "p_brand", p.filter("p_size > 49 and p_retailprice < 950").select("p_brand").distinct())


@query("outlier_fixed", f"""WITH {B.DIRTY} SELECT row_id, {', '.join(f"coalesce({B._outside(c, c)}, false) AS {c}_outlier" for c in ('age', 'salary'))} FROM dirty""")
def outlier_fixed(spark, sf):
    return B.dirty(spark, sf).select("row_id", *[P.outlier_fixed(F.col(c), *vocab.TYPICAL_QUARTILES[c]).alias(f"{c}_outlier") for c in ("age", "salary")])


@query("outlier_range", """SELECT o_orderkey, o_totalprice > 200000 OR o_totalprice < 0 AS outlier FROM orders""")
def outlier_range(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", P.outlier_range(F.col("o_totalprice")).alias("outlier"))


@query("outlier_iqr", f"""WITH {B.DIRTY}, q AS (SELECT quantile_cont(age::DOUBLE, 0.25) AS a1, quantile_cont(age::DOUBLE, 0.75) AS a3, quantile_cont(salary::DOUBLE, 0.25) AS s1, quantile_cont(salary::DOUBLE, 0.75) AS s3 FROM dirty)
  SELECT row_id, coalesce(age < a1 - 1.5 * (a3 - a1) OR age > a3 + 1.5 * (a3 - a1), false) AS age_outlier,
    coalesce(salary < s1 - 1.5 * (s3 - s1) OR salary > s3 + 1.5 * (s3 - s1), false) AS salary_outlier FROM dirty, q""")
def outlier_iqr(spark, sf):
    return D.outlier_iqr(B.dirty(spark, sf), ["age", "salary"]).select("row_id", "age_outlier", "salary_outlier")


@query("outlier_iqr_by_group", """WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
  SELECT l_returnflag, count(*) AS n, (count(*) FILTER (l_extendedprice < q1 - 0.2 * (q3 - q1) OR l_extendedprice > q3 + 0.2 * (q3 - q1)))::BIGINT AS outliers
  FROM lineitem JOIN q ON l_returnflag = f GROUP BY 1""")
def outlier_iqr_by_group(spark, sf):
    l = B.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    o = D.outlier_iqr(l, ["l_extendedprice"], k=0.2, by=["l_returnflag"])
    return o.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("l_extendedprice_outlier").alias("outliers"))


def _sql_conf(c):
    (a, b), (x, y) = vocab.OUTLIER_BANDS[c]
    return f"CASE WHEN {c} < {a} OR {c} > {b} THEN 0.9 WHEN {c} < {x} OR {c} > {y} THEN 0.7 ELSE 0.5 END::DOUBLE"


@query("outlier_confidence", f"""WITH {B.DIRTY} SELECT row_id, {_sql_conf('age')} AS age_conf, {_sql_conf('salary')} AS salary_conf FROM dirty""")
def outlier_confidence(spark, sf):
    return B.dirty(spark, sf).select("row_id", P.outlier_confidence(F.col("age"), "age").alias("age_conf"), P.outlier_confidence(F.col("salary"), "salary").alias("salary_conf"))


@query("detect_issues", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, array_to_string(issues, ',') AS issues FROM found""")
def detect_issues(spark, sf):
    return found(spark, sf).select("row_id", F.array_join("issues", ",").alias("issues"))


def _generic_sql(cols):
    pairs = []
    for c, text in cols:
        pairs.append((f"{c} IS NULL", f"missing:{c}"))
        if text:
            pairs += [(B.sql_numeric(c), f"wrong_type:{c}"), (f"coalesce({c} <> lower({c}), false)", f"formatting:{c}")]
    return B.sql_list(*pairs)


@query("detect_issues_generic", f"""WITH {B.DIRTY} SELECT row_id, array_to_string({_generic_sql([('id', 0), ('name', 1), ('age', 0), ('salary', 0), ('score', 1), ('dept', 1), ('email', 1)])}, ',') AS issues FROM dirty""")
def detect_issues_generic(spark, sf):
    d = B.dirty(spark, sf).select("row_id", *PEOPLE_COLS)
    return D.detect_issues(d, D.generic_rules(d)).select("row_id", F.array_join("issues", ",").alias("issues"))


@query("explode_issues", f"""WITH {B.DIRTY}, {B.ISSUES}, e AS (SELECT row_id, unnest(issues) AS i FROM found)
  SELECT row_id, split_part(i, ':', 1) AS kind, split_part(i, ':', 2) AS "column" FROM e""")
def explode_issues(spark, sf):
    return D.explode_issues(found(spark, sf))


@query("legal_actions", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, {SQL_JOINED.format("list_filter(['skip', CASE WHEN " + B.sql_any('issues', 'missing:') + " THEN 'fill_missing' END, CASE WHEN " + B.sql_any('issues', 'wrong_type:') + " THEN 'fix_type' END, CASE WHEN " + B.sql_any('issues', 'formatting:') + " THEN 'fix_formatting' END, 'remove_duplicate', 'fix_category', 'remove_outlier'], lambda x: x IS NOT NULL)")} AS legal FROM found""")
def legal_actions(spark, sf):
    return found(spark, sf).select("row_id", F.array_join(D.legal_actions(F.col("issues")), ",").alias("legal"))


SQL_EXPECTED = ("CASE WHEN " + " WHEN ".join(
    f"{B.sql_any('issues', p)} THEN '{a}'" for p, a in (
        ("missing:", "fill_missing"), ("duplicate:", "remove_duplicate"), ("outlier:", "remove_outlier"),
        ("category:", "fix_category"), ("formatting:", "fix_formatting"))) + " ELSE 'skip' END")


@query("expected_action", f"""WITH {B.DIRTY}, {B.ALL_ISSUES} SELECT row_id, {SQL_EXPECTED} AS expected FROM found""")
def expected_action(spark, sf):
    return found_all(spark, sf).select("row_id", D.expected_action(F.col("issues")).alias("expected"))


@query("responsible_agent", f"""WITH {B.DIRTY}, {B.ALL_ISSUES}, u AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN list_transform(issues, lambda x: upper(x)) ELSE issues END AS issues FROM found),
  l AS (SELECT row_id, list_transform(issues, lambda x: lower(x)) AS i FROM u)
  SELECT row_id, CASE WHEN {B.sql_has('i', 'missing')} THEN 'FillMissingAgent' WHEN {B.sql_has('i', 'duplicate')} THEN 'DuplicateDetector'
    WHEN {B.sql_has('i', 'outlier')} THEN 'OutlierHandler' WHEN {B.sql_has('i', 'category')} OR {B.sql_has('i', 'format')} THEN 'CategoryStandardizer' ELSE 'SkipAgent' END AS agent FROM l""")
def responsible_agent(spark, sf):
    f = found_all(spark, sf)
    shouted = F.when(F.col("row_id") % 2 == 0, F.transform("issues", F.upper)).otherwise(F.col("issues"))
    return f.select("row_id", D.responsible_agent(shouted).alias("agent"))


@query("can_handle", f"""WITH {B.DIRTY}, {B.ALL_ISSUES} SELECT row_id, {B.sql_any('issues', 'missing:')} AS fill, {B.sql_has('issues', 'duplicate')} AS dup,
  {B.sql_has('issues', 'outlier')} AS outlier, {B.sql_has('issues', 'category')} OR {B.sql_has('issues', 'formatting')} AS category, true AS skip FROM found""")
def can_handle(spark, sf):
    i = F.col("issues")
    names = ["fill", "dup", "outlier", "category", "skip"]
    return found_all(spark, sf).select("row_id", *[D.can_handle(a, i).alias(n) for a, n in zip(vocab.AGENTS, names)])


@query("rows_with_issue", f"""WITH {B.DIRTY}, {B.ISSUES} SELECT row_id, array_to_string(issues, ',') AS issues FROM found WHERE {B.sql_has('issues', 'email')}""")
def rows_with_issue(spark, sf):
    return D.rows_with_issue(found(spark, sf), "EMAIL").select("row_id", F.array_join("issues", ",").alias("issues"))


@query("value_kind", f"""WITH {B.DIRTY} SELECT row_id, CASE WHEN age IS NULL THEN 'null' ELSE 'int' END AS age_kind, CASE WHEN name IS NULL THEN 'null' ELSE 'string' END AS name_kind,
    CASE WHEN salary IS NULL THEN 'null' WHEN salary / 2 = floor(salary / 2) THEN 'int' ELSE 'float' END AS half_kind,
    CASE WHEN age IS NULL THEN 'null' ELSE 'bool' END AS flag_kind FROM dirty""")
def value_kind(spark, sf):
    d = B.dirty(spark, sf).withColumns({"half": F.col("salary") / 2, "flag": F.col("age") > 30})
    kind = lambda c: P.value_kind(F.col(c), d.schema[c].dataType)
    return d.select("row_id", kind("age").alias("age_kind"), kind("name").alias("name_kind"), kind("half").alias("half_kind"), kind("flag").alias("flag_kind"))


@query("search_rows", f"""WITH {B.AUDIT} SELECT id, "column", action_type, agent_used FROM audit
  WHERE (contains(lower("column"), 'fill') OR contains(lower(action_type), 'fill') OR contains(lower(agent_used), 'fill'))""")
def search_rows(spark, sf):
    a = B.audit(spark, sf)
    return a.filter(P.search([F.col("column"), F.col("action_type"), F.col("agent_used")], "FILL")).select("id", "column", "action_type", "agent_used")


@query("filter_status", f"""WITH {B.JOBS} SELECT job_id, status FROM jobs WHERE status = 'completed' AND contains(job_id::VARCHAR, '77')""")
def filter_status(spark, sf):
    return B.jobs(spark, sf).filter((F.col("status") == "completed") & P.search([F.col("job_id")], "77")).select("job_id", "status")


@query("band", f"""WITH {B.AUDIT} SELECT id, confidence, CASE WHEN confidence >= 0.8 THEN 'success' WHEN confidence >= 0.5 THEN 'warning' ELSE 'error' END AS colour FROM audit""")
def band(spark, sf):
    return B.audit(spark, sf).select("id", "confidence", P.band(F.col("confidence"), [(0.8, "success"), (0.5, "warning")], "error").alias("colour"))


@query("display_value", """SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' WHEN text IS NULL OR text IN ('null', '') THEN '-' ELSE text END AS shown,
    CASE WHEN doc_id % 3 = 0 THEN '-' ELSE lang END AS shown_lang FROM documents""")
def display_value(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", P.display_value(F.col("text")).alias("shown"),
        P.display_value(F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("shown_lang"))


@query("issue_counts", f"""WITH {B.DIRTY}, {B.ISSUES}, e AS (SELECT unnest(issues) AS i FROM found)
  SELECT split_part(i, ':', 1) AS kind, split_part(i, ':', 2) AS "column", count(*) AS n FROM e GROUP BY 1, 2""")
def issue_counts(spark, sf):
    return D.issue_counts(found(spark, sf))
