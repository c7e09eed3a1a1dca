"""Error injection and detector scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import inject as I
from tidemark.operators.detect import detect_issues, explode_issues, people_rules
from tidemark.queries import base as B
from tidemark.queries.detection import found
from tidemark.queries.registry import query

COLS = ["row_id", "id", "name", "age", "salary", "score", "dept", "email"]


def _out(df):
    return df.select(*COLS, F.array_join("truth", ",").alias("truth"))


def hit(rate, op, col):
    return f"({B.sql_gate(rate, op, col)} AND {col} IS NOT NULL)"


@query("inject_missing", f"""WITH {B.PEOPLE} SELECT row_id, id, dept, {', '.join(f"CASE WHEN {hit(0.15, 'missing', c)} THEN NULL ELSE {c} END AS {c}" for c in vocab.NULLABLE_COLUMNS)},
  array_to_string({B.sql_list(*[(hit(0.15, 'missing', c), f'missing:{c}') for c in vocab.NULLABLE_COLUMNS])}, ',') AS truth FROM people""")
def inject_missing(spark, sf):
    return _out(I.inject_missing(B.people(spark, sf), 0.3))


@query("inject_missing_exact", f"""WITH {B.PEOPLE}, h AS (SELECT *, ('0x' || substr(md5('42|missing|age|' || row_id::VARCHAR), 1, 13))::BIGINT AS h FROM people), r AS (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM h)
  SELECT row_id, CASE WHEN rn > floor((SELECT count(*) FROM people) * 0.15::DOUBLE) THEN age END AS age FROM r""")
def inject_missing_exact(spark, sf):
    return I.inject_missing(B.people(spark, sf), 0.3, ["age"], exact=True).select("row_id", "age")


@query("inject_duplicates", f"""WITH {B.PEOPLE}, u AS (SELECT *, '' AS truth FROM people UNION ALL SELECT row_id + (SELECT power(10, length(max(row_id)::VARCHAR))::BIGINT FROM people), id,
    CASE WHEN {B.sql_gate(0.3, 'lower', 'name')} THEN lower(name) ELSE name END, age, salary, score, dept, email, 'duplicate:row' FROM people WHERE {B.sql_gate(0.15, 'duplicate', 'row')}) SELECT * FROM u""")
def inject_duplicates(spark, sf):
    return _out(I.inject_duplicates(B.people(spark, sf), 0.15))


_o = 0.1 * 0.3


@query("inject_outliers", f"""WITH {B.PEOPLE} SELECT row_id, id, name, dept, email, {', '.join(f"CASE WHEN {B.sql_gate(_o, 'outlier', c)} THEN ({B.sql_pick(v, 'outlier_value', c)})::{'VARCHAR' if c == 'score' else 'BIGINT'} ELSE {c} END AS {c}" for c, v in vocab.OUTLIER_VALUES.items())},
  array_to_string({B.sql_list(*[(B.sql_gate(_o, 'outlier', c), f'outlier:{c}') for c in vocab.OUTLIER_VALUES])}, ',') AS truth FROM people""")
def inject_outliers(spark, sf):
    return _out(I.inject_outliers(B.people(spark, sf), 0.1))


_typo = "CASE dept " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vocab.DEPT_TYPOS.items()) + " END"


@query("inject_category_errors", f"""WITH {B.PEOPLE} SELECT row_id, id, age, salary, score, email, CASE WHEN {hit(0.1, 'category', 'dept')} THEN {_typo} ELSE dept END AS dept,
  CASE WHEN {hit(0.1, 'category', 'name')} THEN CASE WHEN {B.sql_gate(0.5, 'upper', 'name')} THEN upper(name) ELSE lower(name) END ELSE name END AS name,
  array_to_string({B.sql_list((hit(0.1, 'category', 'dept'), 'category:dept'), (hit(0.1, 'category', 'name'), 'category:name'))}, ',') AS truth FROM people""")
def inject_category_errors(spark, sf):
    return _out(I.inject_category_errors(B.people(spark, sf), 0.2))


@query("inject_type_errors", f"""WITH {B.PEOPLE} SELECT row_id, id, name, age, salary, dept, email, CASE WHEN {hit(0.05, 'type', 'score')} THEN score || ' points' ELSE score END AS score,
  CASE WHEN {hit(0.05, 'type', 'score')} THEN 'wrong_type:score' ELSE '' END AS truth FROM people""")
def inject_type_errors(spark, sf):
    return _out(I.inject_type_errors(B.people(spark, sf), 0.05))


@query("inject_formatting_errors", f"""WITH {B.PEOPLE} SELECT row_id, id, age, salary, score, dept,
  CASE WHEN {hit(0.05, 'formatting', 'email')} THEN CASE WHEN {B.sql_gate(0.5, 'spelled', 'email')} THEN replace(email, '@', ' at ') ELSE email || '.com' END ELSE email END AS email,
  CASE WHEN {hit(0.05, 'formatting', 'name')} THEN CASE WHEN {B.sql_gate(0.5, 'padded', 'name')} THEN name || ' ' ELSE replace(name, ' ', '_') END ELSE name END AS name,
  array_to_string({B.sql_list((hit(0.05, 'formatting', 'email'), 'formatting:email'), (hit(0.05, 'formatting', 'name'), 'formatting:name'))}, ',') AS truth FROM people""")
def inject_formatting_errors(spark, sf):
    return _out(I.inject_formatting_errors(B.people(spark, sf), 0.1))


@query("make_dirty", f"""WITH {B.DIRTY} SELECT row_id, id, name, age, salary, score, dept, email, array_to_string(truth, ',') AS truth FROM dirty""")
def make_dirty(spark, sf):
    return _out(B.dirty(spark, sf))


def sql_permuted(x: str, n: str, rows: str, cols: str, tag: str) -> str:
    """SQL of ``inject.permuted``: ``rows`` and ``cols`` are the sides of the rectangle."""
    def once(v: str) -> str:
        row, col = f"({v} // {cols})", f"({v} % {cols})"
        for r in range(I.ROUNDS):
            if r % 2 == 0:
                row = f"(({row} + {B.sql_hash(f"'{B.SEED}'", f"'{tag}'", 'episode::VARCHAR', f"'{r}'", f'{col}::VARCHAR')}) % {rows})"
            else:
                col = f"(({col} + {B.sql_hash(f"'{B.SEED}'", f"'{tag}'", 'episode::VARCHAR', f"'{r}'", f'{row}::VARCHAR')}) % {cols})"
        return f"({row} * {cols} + {col})"

    return f"list_reduce(list_prepend({once(x)}, range(0, {I.WALKS})), lambda v, u: CASE WHEN v < {n} THEN v ELSE {once('v')} END)"


_TWICE = f"floor(n * {vocab.DIRT_LEVELS['hard']['duplicate']!r}::DOUBLE)::BIGINT"
_EPISODES = f"""{B.PEOPLE}, sizes AS (SELECT count(*)::BIGINT AS n, {_TWICE} AS m FROM people),
sides AS (SELECT *, ceil(sqrt(n))::BIGINT AS da, ceil(sqrt(n + m))::BIGINT AS oa FROM sizes), 
shape AS (SELECT *, ceil(n / da::DOUBLE)::BIGINT AS db, ceil((n + m) / oa::DOUBLE)::BIGINT AS ob FROM sides),
numbered AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place FROM people),
many AS (SELECT numbered.*, e.episode::INT AS episode, e.episode::VARCHAR || ':' || row_id::VARCHAR AS episode_key FROM numbered, (SELECT unnest(range(0, 3)) AS episode) e),
{B.sql_dirty('hard', 'many', 'episode_key', 'episode, episode_key, place, ', episodes=f"""SELECT row_id, episode, episode_key || ':copy', nth + n, id,
    CASE WHEN {B.sql_gate(0.3, 'lower', 'name', 'episode_key')} THEN lower(name) ELSE name END, age, salary, score, dept, email, list_append(truth, 'duplicate:row')
  FROM (SELECT *, {sql_permuted('place', 'n', 'da', 'db', 'duplicate')} AS nth FROM m0, shape) WHERE nth < m""")}, {B.ISSUES}"""


@query("make_episodes", f"""WITH {_EPISODES} SELECT row_id, episode, {sql_permuted('place', '(n + m)', 'oa', 'ob', 'order')} AS row_index, age, salary, score, name, dept, email, array_to_string(issues, ',') AS issues FROM found, shape""")
def make_episodes(spark, sf):
    e = I.make_episodes(B.people(spark, sf), 3)
    d = detect_issues(e, people_rules(e))
    return d.select("row_id", "episode", "row_index", "age", "salary", "score", "name", "dept", "email", F.array_join("issues", ",").alias("issues"))


SCORED = f"""WITH {B.DIRTY}, {B.ISSUES}, t AS (SELECT DISTINCT row_id, unnest(truth) AS i FROM dirty), f AS (SELECT row_id, unnest(issues) AS i FROM found),
  j AS (SELECT split_part(coalesce(t.i, f.i), ':', 1) AS kind, t.i IS NOT NULL AS in_t, f.i IS NOT NULL AS in_f FROM t FULL JOIN f ON t.row_id = f.row_id AND t.i = f.i),
  k AS (SELECT kind, count(*) FILTER (in_t AND in_f) AS hits, count(*) FILTER (in_t) AS in_truth, count(*) FILTER (in_f) AS in_found FROM j GROUP BY 1),
  p AS (SELECT *, CASE WHEN in_found > 0 THEN hits / in_found::DOUBLE ELSE 0 END AS p, CASE WHEN in_truth > 0 THEN hits / in_truth::DOUBLE ELSE 0 END AS r FROM k)
  SELECT kind, hits, in_truth, in_found, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p"""


@query("score_detector", SCORED)
def score_detector(spark, sf):
    s = I.score_detector(found(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("score_detector_tables", SCORED)
def score_detector_tables(spark, sf):
    f = found(spark, sf)
    s = I.score_detector_tables(explode_issues(f, "truth"), explode_issues(f))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("shuffle_rows", f"""WITH {B.PEOPLE} SELECT row_number() OVER (ORDER BY substr(md5('42|shuffle|' || row_id::VARCHAR), 1, 13), row_id) AS row_id, id, name FROM people""")
def shuffle_rows(spark, sf):
    return I.shuffle_rows(B.people(spark, sf)).select("row_id", "id", "name")
