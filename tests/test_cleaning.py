import pytest
from pyspark.sql import functions as F

from tests import tables
from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.operators import clean as C
from tidemark.operators import detect as D
from tidemark.operators import grading as G
from tidemark.operators.actions import apply_actions, cleaned_rows, diff
from tidemark.operators.quality import compare_quality, profile, quality
from tidemark.plans.cleaning import clean, cleaning_job


def one(df, *cols):
    r = df.select(*cols).first()
    return tuple(r)


def test_grades_of_the_fixed_tables(spark):
    assert one(G.grade(tables.medium(spark), "medium"), "passed", "total", "score") == (19, 25, 0.76)
    assert one(G.grade(tables.hard(spark), "hard"), "passed", "total", "score") == (28, 41, 0.68)
    assert one(G.grade(clean(tables.medium(spark), "medium"), "medium"), "score") == (1.0,)
    assert one(G.grade(clean(tables.hard(spark), "hard"), "hard"), "score") == (1.0,)
    empty = tables.hard(spark).filter("false")
    assert one(G.grade(empty, "hard"), "passed", "total", "score") == (0, 0, 0.0)
    easy = spark.createDataFrame([(1, 25, 5, "85"), (2, None, None, "x"), (3, None, 7, None)], "id long, age long, salary long, score string")
    assert one(G.grade(easy, "easy"), "passed", "total") == (6, 12)
    with pytest.raises(ValueError):
        G.grade(empty, "odd")


def test_duplicates_of_the_fixed_tables(spark):
    d = C.flag_duplicates(tables.medium(spark), ["name", "email"])
    assert {r.id for r in d.filter("is_duplicate").collect()} == {4, 7}
    assert {r.id for r in C.flag_duplicates(tables.hard(spark), ["name"]).filter("is_duplicate").collect()} == {5}


def test_one_key_holding_most_rows(spark):
    d = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 != 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    kept = C.drop_duplicates_on(d, ["k"])
    assert kept.count() == len([i for i in range(2000) if i % 3 == 0]) + 1
    assert C.dup_exists(d, ["k"]).count() == 2000 - kept.count()
    assert C.duplicate_ordinal(d, ["k"]).agg(F.max("nth")).first()[0] == len([i for i in range(2000) if i % 3])


@pytest.mark.parametrize("text,ok", [
    ("85", True), (" 8.5 ", True), ("1e5", True), ("-.5", True), ("5.", True), ("nan", True), ("-Infinity", True), ("1_000", True),
    ("1d", False), ("1f", False), ("_1", False), ("1__0", False), ("", False), ("85 points", False), ("0x10", False), (None, False)])
def test_numeric_text_takes_what_float_takes(spark, text, ok):
    def python(t):
        try:
            float(t)
            return True
        except (ValueError, TypeError):
            return False

    assert python(text) == ok
    r = spark.createDataFrame([(text,)], "t string").select(P.numeric_text(F.col("t")), P.parse_number(F.col("t"))).first()
    assert r[0] == ok
    if ok and text != "nan":
        assert r[1] == float(text)


def test_strip_removes_what_python_strips(spark):
    texts = [w + "a b" + w for w in vocab.WHITESPACE]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.strip(F.col("t"))).collect()
    assert {r[0] for r in got} == {"a b"}


@pytest.mark.parametrize("text,want", [
    ("enginering", "engineering"), ("salse", "sales"), ("marketting", "marketing"), ("h.r", "hr"), ("financ", "finance"),
    ("h.r.", "h.r."), ("eng", "eng"), (" Sales ", "sales"), ("HR", "hr"), (None, None), ("", "")])
def test_fuzzy_categories(spark, text, want):
    d = spark.createDataFrame([(text,)], "dept string")
    assert C.fix_category_fuzzy(d, "dept").first()[0] == want


def test_email_domain_only(spark):
    d = spark.createDataFrame([("a.1@gmial.com",), ("b@company.com",), ("no at",)], "email string")
    assert [r[0] for r in C.fix_email_domain(d).collect()] == ["a.1@gmail.com", "b@company.com", "no at"]


def test_fills_treat_null_nan_and_blank_alike(spark):
    d = spark.createDataFrame([(1, float("nan"), " \t"), (2, None, None), (3, 5.0, "x")], "row_id long, age double, name string")
    got = C.fill_defaults(d).orderBy("row_id").collect()
    assert [(r.age, r.name) for r in got] == [(30.0, "unknown"), (30.0, "unknown"), (5.0, "x")]
    assert [r.age for r in C.fill_stat(d, "age", "mean").orderBy("row_id").collect()] == [5.0, 5.0, 5.0]
    assert C.nan_to_null(d).filter("age is null").count() == 2


def test_mode_tie_takes_the_smallest(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "b", "a", None])], "row_id long, v string")
    assert C.fill_stat(d, "v", "mode").filter("row_id = 4").first().v == "a"


def test_lenient_and_strict_types(spark):
    d = spark.createDataFrame([("85 points",), ("7",), ("x",)], "score string")
    assert [r.score for r in C.fix_type(d, "score", failed="bad").collect()] == [None, 7.0, None]
    assert [r.score for r in C.fix_type_lenient(d, "score").collect()] == [85.0, 7.0, None]


def test_fixes_are_idempotent_and_never_lower_quality(spark):
    for df, plan in ((tables.medium(spark), "medium"), (tables.hard(spark), "hard")):
        once = clean(df, plan)
        assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, clean(once, plan).collect()), key=str)
        assert quality(once).first().quality_score >= quality(df).first().quality_score
        assert compare_quality(df, once).first().improvement >= 0


def test_issue_rules(spark):
    d = tables.medium(spark)
    got = {r.id: r.issues for r in D.detect_issues(d, D.generic_rules(d)).collect()}
    assert got[1] == ["formatting:email", "missing:age"] and got[2] == ["formatting:name"] and got[5] == ["missing:name"]
    with pytest.raises(ValueError):
        D.Rule("strange", "age", F.lit(True))
    with pytest.raises(ValueError):
        G.Check("x", F.lit(True), "cell")
    with pytest.raises(ValueError):
        D.can_handle("Nobody", F.array())


def sequential_actions(rows, actions):
    """The row-by-row rules, one after another."""
    kept, out = [], []
    for row in rows:
        row = dict(row)
        action, col, value = actions[row["row_id"]]
        ok = removed = False
        if action == "fill_missing" and row.get(col) is None:
            row[col], ok = value, True
        elif action == "fix_type" and row.get(col) is not None:
            try:
                row[col], ok = str(float(row[col])), True
            except ValueError:
                pass
        elif action == "remove_duplicate":
            ok = removed = any(k["name"] == row["name"] and k["email"] == row["email"] for k in kept)
        elif action == "fix_category" and row.get(col) in vocab.CATEGORY_MAP:
            row[col], ok = vocab.CATEGORY_MAP[row[col]], True
        elif action == "remove_outlier" and row.get(col) is not None and (row[col] > 200000 or row[col] < 0):
            row[col], ok = 70000, True
        elif action == "fix_formatting" and isinstance(row.get(col), str):
            row[col], ok = row[col].lower().strip(), True
        good, bad = vocab.STEP_REWARDS.get(action, (-0.3, -0.3))
        if not removed:
            kept.append(row)
        out.append((row["row_id"], removed, good if ok else bad))
    return kept, out


def test_actions_equal_the_row_by_row_rules(spark):
    import random

    rnd = random.Random(11)
    names, mails, depts = ["a", "B", None], ["x@y", "X@Y", " x@y ", None], ["eng", "HR", "finance", None]
    rows, actions = [], {}
    kinds = [("fill_missing", "name", "B"), ("fill_missing", "salary", "5"), ("fix_type", "score", None), ("remove_duplicate", "id", None),
             ("remove_duplicate", "id", None), ("fix_category", "dept", None), ("remove_outlier", "salary", None),
             ("fix_formatting", "email", None), ("skip", "id", None), ("dance", "id", None)]
    for i in range(400):
        rows.append(dict(row_id=i, name=rnd.choice(names), email=rnd.choice(mails), dept=rnd.choice(depts),
                         salary=rnd.choice([None, 10, -1, 300000]), score=rnd.choice(["1", "x", None])))
        actions[i] = rnd.choice(kinds)
    schema = "row_id long, name string, email string, dept string, salary long, score string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    act = spark.createDataFrame([(i, *a) for i, a in actions.items()], "row_id long, action_type string, column string, value string")
    typed = {i: (a, c, int(v) if c == "salary" and v else v) for i, (a, c, v) in actions.items()}
    kept, log = sequential_actions(rows, typed)
    applied = apply_actions(df, act).cache()
    assert sorted((r.row_id, r.removed, r.reward) for r in applied.collect()) == sorted(log)
    got = {r.row_id: r.asDict() for r in cleaned_rows(applied, df.columns).collect()}
    assert got == {r["row_id"]: r for r in kept}


def test_diff_lists_changed_cells_only(spark):
    d = tables.medium(spark)
    rows = {(r.row_id, r.column, r.old_value, r.new_value) for r in diff(d, C.fill_defaults(d)).collect()}
    assert rows == {(1, "age", None, "30"), (6, "age", None, "30"), (5, "name", None, "unknown")}


def test_profile(spark):
    p = {r["column"]: r for r in profile(tables.hard(spark)).collect()}
    assert p["salary"].missing == 1 and p["salary"].distinct == 6 and p["salary"].max == 999999 and p["salary"].outliers == 2
    assert p["dept"].type == "string" and p["dept"].q1 is None
    approx = {r["column"]: r for r in profile(tables.hard(spark), approximate=True).collect()}
    assert approx["age"].missing == 3


def test_job(spark):
    d = tables.medium(spark).withColumns({"salary": F.lit(50000).cast("long"), "score": F.lit("80"), "dept": F.lit("sales")})
    job = cleaning_job(d, "job-1", F.lit("2024-01-01").cast("timestamp"))
    assert job.audit.count() == 8 and job.cleaned.count() == 6
    m = {r.phase: r for r in job.metrics.collect()}
    assert m["cleaned"].missing_pct < m["original"].missing_pct
    agents = {r.row_index: (r.agent_used, r.action_type) for r in job.audit.collect()}
    assert agents[1] == ("FillMissingAgent", "fill_missing") and agents[4] == ("DuplicateDetector", "remove_duplicate")


def test_job_writes_what_it_decides(spark):
    """Typos that no literal map knows, outliers that only the typical range tells, blanks; addresses stay as they are."""
    rows = [(i, i, f"person {i}", 40, 60000, 80.0, d, f"p{i}@gmail.com") for i, d in enumerate(
        ["enginering", "marketting", "finanse", "engineering", "hr"])]
    rows += [(5, 5, "person 5", -40, 60000, 80.0, "hr", "p5@gmail.com"), (6, 6, "person 6", 130, 60000, 80.0, "hr", "p6@gmail.com"),
             (7, 7, "person 7", 40, 999999, 80.0, "hr", "p7@gmail.com"), (8, 8, "   ", 40, 60000, 80.0, "hr", "p8@gmail.com"),
             (9, 9, "person 9", 40, 60000, 80.0, "hr", "c at gmail.com")]
    d = spark.createDataFrame(rows, "row_id long, id long, name string, age long, salary long, score double, dept string, email string")
    job = cleaning_job(d, "job", F.lit("2024-01-01").cast("timestamp"))
    got = {r.row_id: r for r in job.cleaned.collect()}
    took = {r.row_id: r for r in job.applied.collect()}
    for i, (_, _, _, _, _, _, dept, _) in enumerate(rows[:3]):
        if took[i].action_type == "fix_category":
            assert took[i].took_effect and got[i].dept == took[i].decision.value != dept
    assert got[0].dept == "engineering"
    assert (got[5].age, got[6].age, got[7].salary) == (35, 35, 75000) and all(took[i].took_effect for i in (5, 6, 7))
    assert got[8].name == "unknown" and took[8].took_effect
    assert [got[i].email for i in range(10)] == [r[7] for r in rows]


def test_long_list_of_known_values(spark):
    known = [f"category number {i:05d}" for i in range(0, 30000, 17)]
    d = spark.createDataFrame([(0, "category nummber 00034"), (1, "Category Number 00017 "), (2, "nothing like it at all, really"), (3, None)], "row_id long, c string")
    got = {r.row_id: r.c for r in C.fix_category_fuzzy(d, "c", known, 0.9).collect()}
    assert got == {0: "category number 00034", 1: "category number 00017", 2: "nothing like it at all, really", 3: None}


def test_texts(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 01:05:30")], "a string, b string").selectExpr("timestamp(a) a", "timestamp(b) b")
    a, b = F.col("a"), F.col("b")
    assert one(d, S.elapsed_text(a, b), S.eta_text(S.eta_minutes(a, b, F.lit(10), F.lit(30)))) == ("1h 5m", "~2h 11m")
    assert one(d, S.eta_text(S.eta_minutes(a, b, F.lit(0), F.lit(30)))) == ("Calculating...",)
    sizes = [S.human_size(F.lit(n)) for n in (5, 2048, 5 * 1024**2, 3 * 1024**3)]
    assert one(d, *sizes) == ("5 B", "2.0 KB", "5.0 MB", "3.0 GB")
    assert one(d, P.display_value(F.lit("x" * 60)), P.display_value(F.lit(""))) == ("x" * 50 + "...", "-")
