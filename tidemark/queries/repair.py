"""Fills, casts, category and outlier repairs, duplicate removal, actions and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.similarity import register
from tidemark.operators import clean as C
from tidemark.operators import decide as D
from tidemark.operators import fuzzy as Z
from tidemark.operators import joins as J
from tidemark.operators.actions import apply_actions, cleaned_rows, diff
from tidemark.operators.detect import expected_action
from tidemark.plans.cleaning import clean
from tidemark.queries import base as B
from tidemark.queries.detection import numberish, NUMBERISH_SQL, SQL_EXPECTED
from tidemark.queries.registry import query

ROW = ["row_id", "id", "name", "age", "salary", "score", "dept", "email"]
WS = "' ' || chr(9) || chr(10) || chr(13)"


@query("fill_value", f"""WITH {B.DIRTY} SELECT row_id, coalesce(age, 30) AS age, CASE WHEN name IS NULL OR trim(name) = '' THEN 'unknown' ELSE name END AS name FROM dirty""")
def fill_value(spark, sf):
    return C.fill_value(C.fill_value(B.dirty(spark, sf), "age", 30), "name", "unknown").select("row_id", "age", "name")


def _sql_fill(c):
    v = vocab.FILL_DEFAULTS[c]
    if c in ("age", "salary"):
        return f"coalesce({c}, {v}) AS {c}"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN '{v}' ELSE {c} END AS {c}"


SQL_FILLED = "row_id, id, " + ", ".join(_sql_fill(c) for c in ("name", "age", "salary", "score", "dept", "email"))


@query("fill_defaults", f"""WITH {B.DIRTY} SELECT {SQL_FILLED} FROM dirty""")
def fill_defaults(spark, sf):
    return C.fill_defaults(B.dirty(spark, sf)).select(ROW)


@query("fill_stat_median", f"""WITH {B.DIRTY} SELECT row_id, coalesce(age, trunc((SELECT quantile_cont(age::DOUBLE, 0.5) FROM dirty))::BIGINT) AS age FROM dirty""")
def fill_stat_median(spark, sf):
    return C.fill_stat(B.dirty(spark, sf), "age", "median").select("row_id", "age")


@query("fill_stat_mean", f"""WITH {B.DIRTY} SELECT row_id, coalesce(salary, trunc((SELECT avg(salary::DOUBLE) FROM dirty))::BIGINT) AS salary FROM dirty""")
def fill_stat_mean(spark, sf):
    return C.fill_stat(B.dirty(spark, sf), "salary", "mean").select("row_id", "salary")


@query("fill_stat_mode", f"""WITH {B.DIRTY}, m AS (SELECT score FROM dirty WHERE score IS NOT NULL AND trim(score) <> '' GROUP BY score ORDER BY count(*) DESC, score LIMIT 1)
  SELECT row_id, CASE WHEN score IS NULL OR trim(score) = '' THEN (SELECT score FROM m) ELSE score END AS score FROM dirty""")
def fill_stat_mode(spark, sf):
    return C.fill_stat(B.dirty(spark, sf), "score", "mode").select("row_id", "score")


@query("fill_stat_median_by_group", f"""WITH {B.DIRTY}, m AS (SELECT dept AS d, quantile_cont(salary::DOUBLE, 0.5) AS v FROM dirty GROUP BY dept)
  SELECT row_id, coalesce(salary, trunc(v)::BIGINT) AS salary FROM dirty LEFT JOIN m ON dept IS NOT DISTINCT FROM d""")
def fill_stat_median_by_group(spark, sf):
    return C.fill_stat(B.dirty(spark, sf), "salary", "median", by=["dept"]).select("row_id", "salary")


@query("fix_type", f"""WITH {NUMBERISH_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {B.sql_number('t')} AS t, NOT {B.sql_numeric('t')} AS failed FROM numberish""")
def fix_type(spark, sf):
    return C.fix_type(numberish(spark, sf), "t", failed="failed")


@query("fix_type_lenient", f"""WITH {B.DIRTY} SELECT row_id, try_cast(nullif(regexp_extract(score, '^\\s*([+-]?[0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE) AS score FROM dirty""")
def fix_type_lenient(spark, sf):
    return C.fix_type_lenient(B.dirty(spark, sf), "score").select("row_id", "score")


@query("fix_formatting", f"""WITH {B.DIRTY} SELECT row_id, trim(lower(name), {WS}) AS name, trim(lower(email), {WS}) AS email FROM dirty""")
def fix_formatting(spark, sf):
    return B.dirty(spark, sf).select("row_id", C.fix_formatting(F.col("name")).alias("name"), C.fix_formatting(F.col("email")).alias("email"))


SQL_MAP = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.CATEGORY_MAP.items()) + " ELSE {c} END"


@query("fix_category_map", f"""WITH {B.DIRTY} SELECT row_id, {SQL_MAP.format(c='dept')} AS dept FROM dirty""")
def fix_category_map(spark, sf):
    return C.fix_category_map(B.dirty(spark, sf), "dept").select("row_id", "dept")


# what the closest known value is for every dirty value of the closed sets (0.7 and more of the text in common)
_dept_fixed = "CASE dept " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in vocab.DEPT_TYPOS.items()) + " ELSE dept END"
_domain_fixed = "CASE split_part(email, '@', 2) " + " ".join(f"WHEN '{d}.com' THEN '{d}'" for d in vocab.KNOWN_CATEGORIES["email"]) + " ELSE split_part(email, '@', 2) END"


@query("fix_category_fuzzy", f"""WITH {B.DIRTY} SELECT row_id, {_dept_fixed} AS dept FROM dirty""")
def fix_category_fuzzy(spark, sf):
    return C.fix_category_fuzzy(B.dirty(spark, sf), "dept").select("row_id", "dept")


def sql_ratio(pairs: str) -> str:
    """CTEs that end in ``ratios(x, y, ratio)`` for a relation of distinct (x, y): the longest common stretch - the first in x, then in y -
    and the same to its left and right, until nothing is in common."""
    best = """list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j: {{
      'k': len(list_filter(range(1, least(length({a}) - i, length({b}) - j) + 2), lambda n: substr({a}, i::INT, n::INT) = substr({b}, j::INT, n::INT))), 'i': -i, 'j': -j}}))))"""
    return f"""stretches AS (
      SELECT x, y, x AS a, y AS b, {best.format(a='x', b='y')} AS m FROM {pairs} WHERE x <> '' AND y <> ''
      UNION ALL
      SELECT x, y, a, b, {best.format(a='a', b='b')} FROM (
        SELECT x, y, CASE side WHEN 0 THEN left(a, (-m.i - 1)::INT) ELSE substr(a, (m.k - m.i)::INT) END AS a,
          CASE side WHEN 0 THEN left(b, (-m.j - 1)::INT) ELSE substr(b, (m.k - m.j)::INT) END AS b
        FROM stretches, (VALUES (0), (1)) sides(side) WHERE m.k > 0) WHERE a <> '' AND b <> ''),
    ratios AS (SELECT x, y, 2.0::DOUBLE * sum(m.k) / (length(x) + length(y)) AS ratio FROM stretches GROUP BY x, y)"""


@query("sql_ratio", f"""WITH RECURSIVE {B.DIRTY}, known AS (SELECT unnest([{', '.join(f"'{d}'" for d in vocab.DEPT_OPTIONS)}]) AS y),
  pairs AS (SELECT DISTINCT dept AS x, y FROM dirty, known WHERE dept IS NOT NULL), {sql_ratio('pairs')}
  SELECT row_id, dept, y AS known, round(ratio, 9) AS ratio FROM dirty JOIN ratios ON dept = x""")
def sql_ratio_query(spark, sf):
    register(spark)
    B.dirty(spark, sf).select("row_id", "dept").createOrReplaceTempView("dirty_depts")
    known = ", ".join(f"'{d}'" for d in vocab.DEPT_OPTIONS)
    return spark.sql(f"""SELECT row_id, dept, known, round(ratcliff_ratio(dept, known), 9) AS ratio
                         FROM dirty_depts LATERAL VIEW explode(array({known})) AS known WHERE dept IS NOT NULL""")


@query("fix_category_fuzzy_long", f"""WITH RECURSIVE {B.DIRTY}, known AS (SELECT lower(v) AS y, min(pos) AS pos FROM (
    SELECT unnest([{', '.join(f"'{d}'" for d in vocab.DEPT_OPTIONS)}]) AS v, 0 AS pos UNION ALL SELECT p_brand || ' ' || p_name, p_partkey + 1 FROM part) GROUP BY 1),
  given AS (SELECT row_id, dept, trim(lower(dept), {WS}) AS x FROM dirty),
  pairs AS (SELECT DISTINCT x, y FROM given, known WHERE x <> y AND 2.0 * least(length(x), length(y)) / (length(x) + length(y)) >= 0.7), {sql_ratio('pairs')},
  best AS (SELECT x, arg_min(y, (-ratio, pos, y)) AS y FROM ratios JOIN known USING (y) WHERE ratio >= 0.7 GROUP BY x)
  SELECT row_id, CASE WHEN x IN (SELECT y FROM known) THEN x ELSE coalesce(best.y, dept) END AS dept FROM given LEFT JOIN best USING (x)""")
def fix_category_fuzzy_long(spark, sf):
    names = B.table(spark, sf, "part").select(F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("value"), (F.col("p_partkey") + 1).alias("pos"))
    own = spark.createDataFrame([(d, 0) for d in vocab.DEPT_OPTIONS], "value string, pos long")
    known = own.unionByName(names).groupBy("value").agg(F.min("pos").alias("pos"))
    return Z.closest_known(B.dirty(spark, sf), "dept", known).select("row_id", "dept")


@query("fix_email_domain", f"""WITH {B.DIRTY} SELECT row_id, CASE WHEN contains(email, '@') THEN split_part(email, '@', 1) || '@' || {_domain_fixed} ELSE email END AS email FROM dirty""")
def fix_email_domain(spark, sf):
    return C.fix_email_domain(B.dirty(spark, sf)).select("row_id", "email")


@query("replace_outlier_const", f"""WITH {B.DIRTY} SELECT row_id, CASE WHEN salary > 200000 OR salary < 0 THEN 70000 ELSE salary END AS salary FROM dirty""")
def replace_outlier_const(spark, sf):
    return C.replace_outlier_const(B.dirty(spark, sf), "salary").select("row_id", "salary")


@query("replace_outlier_typical", f"""WITH {B.DIRTY} SELECT row_id, CASE WHEN {B._outside('age', 'age')} THEN 35 ELSE age END AS age, CASE WHEN {B._outside('salary', 'salary')} THEN 75000 ELSE salary END AS salary FROM dirty""")
def replace_outlier_typical(spark, sf):
    return C.replace_outlier_typical(C.replace_outlier_typical(B.dirty(spark, sf), "age"), "salary").select("row_id", "age", "salary")


def _sql_quart(c):
    return f"q AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM dirty)"


@query("replace_outlier_median", f"""WITH {B.DIRTY}, {_sql_quart('salary')} SELECT row_id, CASE WHEN salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1) THEN trunc(q2)::BIGINT ELSE salary END AS salary FROM dirty, q""")
def replace_outlier_median(spark, sf):
    return C.replace_outlier_median(B.dirty(spark, sf), "salary").select("row_id", "salary")


@query("cap_outlier", f"""WITH {B.DIRTY}, {_sql_quart('salary')} SELECT row_id, CASE WHEN salary IS NOT NULL THEN trunc(least(greatest(salary::DOUBLE, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)))::BIGINT END AS salary FROM dirty, q""")
def cap_outlier(spark, sf):
    return C.cap_outlier(B.dirty(spark, sf), "salary").select("row_id", "salary")


@query("drop_duplicates_on", f"""WITH {B.DIRTY}, r AS (SELECT *, row_number() OVER (PARTITION BY name, email ORDER BY row_id) AS rn FROM dirty)
  SELECT row_id, id, name, age, salary, score, dept, email FROM r WHERE rn = 1""")
def drop_duplicates_on(spark, sf):
    return C.drop_duplicates_on(B.dirty(spark, sf), ["name", "email"]).select(ROW)


MEDIUM_COLS = ["id", "name", "age", "salary", "score", "dept", "email"]


@query("flag_duplicates", f"""WITH {B.DIRTY_MEDIUM} SELECT row_id, row_number() OVER (PARTITION BY id, name, age, salary, score, dept, email ORDER BY row_id) > 1 AS is_duplicate FROM dirty""")
def flag_duplicates(spark, sf):
    return C.flag_duplicates(B.dirty(spark, sf, "medium"), MEDIUM_COLS).select("row_id", "is_duplicate")


@query("duplicate_ordinal", f"""WITH {B.DIRTY} SELECT row_id, row_number() OVER (PARTITION BY dept, score ORDER BY row_id) AS nth FROM dirty""")
def duplicate_ordinal(spark, sf):
    return C.duplicate_ordinal(B.dirty(spark, sf), ["dept", "score"]).select("row_id", "nth")


@query("dup_exists", f"""WITH {B.DIRTY} SELECT row_id, name, email FROM dirty d WHERE EXISTS (SELECT 1 FROM dirty e WHERE e.name IS NOT DISTINCT FROM d.name AND e.email IS NOT DISTINCT FROM d.email AND e.row_id < d.row_id)""")
def dup_exists(spark, sf):
    return C.dup_exists(B.dirty(spark, sf), ["name", "email"]).select("row_id", "name", "email")


# narrow columns' ratios first, then common characters as a bound of the others, then all ratios of what is left
_TEXTS = {c: f"coalesce({c}::VARCHAR, 'None')" for c in MEDIUM_COLS}
_WIDE = ["id", "name", "salary", "email"]


def _common(a: str, b: str) -> str:
    return f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


_PAIR_BOUND = " + ".join(_common(f"r.k_{c}", f"s.k_{c}") for c in _WIDE)
SIMILAR = f"""{B.DIRTY_MEDIUM},
  rows_ AS (SELECT row_id, {', '.join(f'{t} AS {c}' for c, t in _TEXTS.items())} FROM dirty),
  reps AS (SELECT min(row_id) AS row_id, {', '.join(MEDIUM_COLS)} FROM rows_ GROUP BY ALL),
  chars AS (SELECT *, {', '.join(f"list_transform(range(1, length({c}) + 1), lambda i: substr({c}, i::INT, 1) || '#' || length(replace(left({c}, i::INT), substr({c}, i::INT, 1), ''))::INT - i) AS k_{c}" for c in _WIDE)} FROM reps),
  narrow AS ({' UNION '.join(f"SELECT a.v AS x, b.v AS y FROM (SELECT DISTINCT {c} AS v FROM reps) a, (SELECT DISTINCT {c} AS v FROM reps) b" for c in ('age', 'score', 'dept'))}),
  {sql_ratio('narrow')},
  near AS (SELECT r.row_id, s.row_id AS other_id, a.ratio + b.ratio + d.ratio AS known
    FROM reps r JOIN reps s ON r.row_id > s.row_id JOIN ratios a ON a.x = r.age AND a.y = s.age JOIN ratios b ON b.x = r.score AND b.y = s.score
    JOIN ratios d ON d.x = r.dept AND d.y = s.dept WHERE a.ratio + b.ratio + d.ratio >= 0.9 - 1e-9),
  met AS (SELECT n.* FROM near n JOIN chars r ON r.row_id = n.row_id JOIN chars s ON s.row_id = n.other_id WHERE known + {_PAIR_BOUND} >= 4.9 - 1e-9),
  wide AS ({' UNION '.join(f"SELECT r.{c} AS x, s.{c} AS y FROM met JOIN reps r ON r.row_id = met.row_id JOIN reps s ON s.row_id = other_id" for c in _WIDE)}),
  {sql_ratio('wide').replace('stretches', 'wide_stretches').replace('ratios', 'wide_ratios')},
  alike AS (SELECT met.row_id, other_id, round((known + {' + '.join(f'w_{c}.ratio' for c in _WIDE)}) / 7, 9) AS similarity
    FROM met JOIN reps r ON r.row_id = met.row_id JOIN reps s ON s.row_id = other_id {' '.join(f'JOIN wide_ratios w_{c} ON w_{c}.x = r.{c} AND w_{c}.y = s.{c}' for c in _WIDE)}),
  matches AS (SELECT * FROM alike WHERE similarity >= 0.7),
  copies AS (SELECT rows_.row_id, reps.row_id AS other_id FROM rows_ JOIN reps USING ({', '.join(MEDIUM_COLS)}) WHERE rows_.row_id > reps.row_id)"""


@query("fuzzy_duplicates", f"""WITH RECURSIVE {SIMILAR} SELECT row_id, max(similarity) AS similarity FROM matches GROUP BY 1 UNION ALL SELECT row_id, 1.0 FROM copies""")
def fuzzy_duplicates(spark, sf):
    d = B.dirty(spark, sf, "medium")
    return Z.fuzzy_duplicates(d, MEDIUM_COLS).withColumn("similarity", F.round("similarity", 9))


@query("candidate_pairs", f"""WITH RECURSIVE {SIMILAR} SELECT row_id, other_id, similarity, false AS "copy" FROM matches UNION ALL SELECT row_id, other_id, 1.0, true FROM copies""")
def candidate_pairs(spark, sf):
    d = B.dirty(spark, sf, "medium")
    return Z.candidate_pairs(d, MEDIUM_COLS).withColumn("similarity", F.round("similarity", 9))


@query("apply_actions", f"""WITH {B.DIRTY}, act AS (
    SELECT row_id, CASE row_id % 7 WHEN 0 THEN 'fill_missing' WHEN 1 THEN 'fix_type' WHEN 2 THEN 'remove_duplicate' WHEN 3 THEN 'fix_category' WHEN 4 THEN 'remove_outlier' WHEN 5 THEN 'fix_formatting' ELSE 'skip' END AS a,
      CASE row_id % 7 WHEN 0 THEN 'age' WHEN 1 THEN 'score' WHEN 2 THEN 'id' WHEN 3 THEN 'dept' WHEN 4 THEN 'salary' WHEN 5 THEN 'email' ELSE 'id' END AS c FROM dirty),
  n AS (SELECT d.row_id, d.name, d.email AS raw_email, a, c,
      CASE WHEN a = 'fill_missing' AND age IS NULL THEN 30 ELSE age END AS age,
      CASE WHEN a = 'fix_type' AND {B.sql_numeric('score')} THEN ({B.sql_number('score')})::VARCHAR ELSE score END AS score,
      CASE WHEN a = 'fix_category' THEN {SQL_MAP.format(c='dept')} ELSE dept END AS dept,
      CASE WHEN a = 'remove_outlier' AND (salary > 200000 OR salary < 0) THEN 70000 ELSE salary END AS salary,
      CASE WHEN a = 'fix_formatting' THEN trim(lower(email), {WS}) ELSE email END AS email,
      CASE a WHEN 'fill_missing' THEN age IS NULL WHEN 'fix_type' THEN {B.sql_numeric('score')} WHEN 'fix_category' THEN dept IN ({', '.join(f"'{k}'" for k in vocab.CATEGORY_MAP)})
        WHEN 'remove_outlier' THEN coalesce(salary > 200000 OR salary < 0, false) WHEN 'fix_formatting' THEN email IS NOT NULL ELSE false END AS ok0
    FROM dirty d JOIN act USING (row_id)),
  f AS (SELECT name AS k1, email AS k2, min(row_id) AS first_id FROM n GROUP BY 1, 2),
  r AS (SELECT n.*, a = 'remove_duplicate' AND coalesce(first_id < row_id, false) AS removed FROM n LEFT JOIN f ON name IS NOT DISTINCT FROM k1 AND raw_email IS NOT DISTINCT FROM k2)
  SELECT row_id, name, age, score, dept, salary, email, a AS action_type, removed, coalesce(CASE WHEN a = 'remove_duplicate' THEN removed ELSE ok0 END, false) AS took_effect,
    CASE a {' '.join(f"WHEN '{k}' THEN CASE WHEN coalesce(CASE WHEN a = 'remove_duplicate' THEN removed ELSE ok0 END, false) THEN {g} ELSE {b} END" for k, (g, b) in vocab.STEP_REWARDS.items())} ELSE -0.3 END::DOUBLE AS reward FROM r""")
def apply_actions_query(spark, sf):
    d = B.dirty(spark, sf).drop("truth")
    k = F.pmod(F.col("row_id"), F.lit(7)).cast("int")
    acts = ["fill_missing", "fix_type", "remove_duplicate", "fix_category", "remove_outlier", "fix_formatting", "skip"]
    cols = ["age", "score", "id", "dept", "salary", "email", "id"]
    actions = d.select("row_id", F.get(F.array(*[F.lit(a) for a in acts]), k).alias("action_type"),
                       F.get(F.array(*[F.lit(c) for c in cols]), k).alias("column"),
                       F.when(k == 0, "30").alias("value"))
    a = apply_actions(d, actions)
    return a.select("row_id", "name", "age", "score", "dept", "salary", "email", "action_type", "removed", "took_effect", "reward")


@query("skip_action", f"""WITH {B.DIRTY} SELECT row_id, name, age, -0.2::DOUBLE AS reward FROM dirty""")
def skip_action(spark, sf):
    d = B.dirty(spark, sf).drop("truth")
    acts = d.select("row_id", F.lit("skip").alias("action_type"), F.lit("id").alias("column"), F.lit(None).cast("string").alias("value"))
    return cleaned_rows(apply_actions(d, acts), ["row_id", "name", "age"]).withColumn("reward", F.lit(-0.2))


@query("clean_easy", f"""WITH {B.DIRTY_EASY}, f AS (SELECT {SQL_FILLED} FROM dirty) SELECT row_id, id, name, age, salary, {B.sql_number('score')} AS score, dept, email FROM f""")
def clean_easy(spark, sf):
    return clean(B.dirty(spark, sf, "easy"), "easy").select(ROW)


@query("clean_medium", f"""WITH {B.DIRTY_MEDIUM}, r AS (SELECT *, row_number() OVER (PARTITION BY name, email ORDER BY row_id) AS rn FROM dirty),
  f AS (SELECT {SQL_FILLED} FROM r WHERE rn = 1) SELECT row_id, id, name, age, salary, score, dept, trim(lower(email), {WS}) AS email FROM f""")
def clean_medium(spark, sf):
    return clean(B.dirty(spark, sf, "medium"), "medium").select(ROW)


_lenient = "try_cast(nullif(regexp_extract(score, '^\\s*([+-]?[0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE)"
SQL_CLEAN_HARD = f"""rr AS (SELECT *, row_number() OVER (PARTITION BY name, email ORDER BY row_id) AS rn FROM dirty),
  ff AS (SELECT {SQL_FILLED} FROM rr WHERE rn = 1),
  cleaned AS (SELECT row_id, id, name, CASE WHEN {B._outside('age', 'age')} THEN 35 ELSE age END AS age,
    CASE WHEN salary > 200000 OR salary < 0 THEN 70000 ELSE salary END AS salary,
    CASE WHEN {B._outside(_lenient, 'score')} THEN 80.0 ELSE {_lenient} END::DOUBLE AS score, {SQL_MAP.format(c='dept')} AS dept, trim(lower(email), {WS}) AS email FROM ff)"""


@query("clean_hard", f"""WITH {B.DIRTY}, {SQL_CLEAN_HARD} SELECT row_id, id, name, age, salary, score, dept, email FROM cleaned""")
def clean_hard(spark, sf):
    return clean(B.dirty(spark, sf), "hard").select(ROW)


@query("diff_changes", f"""WITH {B.DIRTY}, f AS (SELECT {SQL_FILLED} FROM dirty), j AS (SELECT d.row_id, unnest([
    {', '.join(f"CASE WHEN d.{c} IS DISTINCT FROM f.{c} THEN {{'c': '{c}', 'o': d.{c}::VARCHAR, 'n': f.{c}::VARCHAR}} END" for c in ('id', 'name', 'age', 'salary', 'score', 'dept', 'email'))}]) AS x FROM dirty d JOIN f USING (row_id))
  SELECT row_id, x.c AS "column", x.o AS old_value, x.n AS new_value FROM j WHERE x IS NOT NULL""")
def diff_changes(spark, sf):
    d = B.dirty(spark, sf).drop("truth")
    return diff(d, C.fill_defaults(d))


@query("lookup_category", f"""WITH {B.DIRTY}, {B.sql_values('m', vocab.DEPT_TYPOS)} SELECT row_id, coalesce(m.value, dept) AS canonical FROM dirty LEFT JOIN m ON dept = m.canonical""")
def lookup_category(spark, sf):
    m = spark.createDataFrame([(v, k) for k, v in vocab.DEPT_TYPOS.items()], "value string, canonical string")
    return J.lookup_category(B.dirty(spark, sf), "dept", m).select("row_id", "canonical")


@query("chosen_vs_expected", f"""WITH {B.DECISIONS} SELECT action_type, {SQL_EXPECTED} AS expected, action_type = ({SQL_EXPECTED}) AS correct, count(*) AS n FROM decisions GROUP BY ALL""")
def chosen_vs_expected(spark, sf):
    r = B.decisions(spark, sf, steps=False)
    d = J.chosen_vs_expected(r.select("row_id", "action_type"), r.select("row_id", expected_action(F.col("issues")).alias("action_type")))
    return d.groupBy("action_type", "expected", "correct").agg(F.count(F.lit(1)).alias("n"))
