import pytest
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import inject as I
from tidemark.operators import sampling as K
from tidemark.operators.detect import detect_issues, people_rules


@pytest.fixture(scope="module")
def people(spark):
    return I.people_table(spark, 3000, seed=7).cache()


def test_people(people):
    assert people.count() == 3000 and people.select("id").distinct().count() == 3000
    r = people.agg(F.min("age"), F.max("age"), F.avg("age"), F.min(F.col("score").cast("int")), F.max(F.col("score").cast("int"))).first()
    assert r[0] >= 18 and r[1] <= 70 and 33 < r[2] < 38 and r[3] >= 0 and r[4] <= 100
    for dept, (lo, hi) in vocab.SALARY_RANGES.items():
        s = people.filter(F.col("dept") == dept).agg(F.min("salary"), F.max("salary")).first()
        assert lo <= s[0] and s[1] <= hi
    assert people.filter(~F.col("email").rlike(r"^[a-z]+\.\d{1,2}@[a-z]+\.com$")).count() == 0


def test_exact_counts(people):
    d = I.inject_missing(people, 0.2, ["age", "name"], exact=True)
    assert d.filter("age is null").count() == 300 and d.filter("name is null").count() == 300
    assert I.inject_duplicates(people, 0.15, exact=True).count() == 3450
    assert I.inject_type_errors(people, 0.05, exact=True).filter(F.col("score").contains("points")).count() == 150
    o = I.inject_outliers(people, 0.1, exact=True)
    assert o.filter(F.array_contains("truth", "outlier:age")).count() == 90


def test_same_seed_same_errors(people):
    a, b = (I.make_dirty(people.repartition(n), "hard") for n in (2, 7))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_rates_rise_with_the_level(people):
    found = []
    for level in ("easy", "medium", "hard"):
        d = I.make_dirty(people, level)
        found.append(d.select(F.explode("truth")).count())
    assert found[0] < found[1] < found[2]
    with pytest.raises(ValueError):
        I.make_dirty(people, "odd")


def test_detectors_find_what_was_put_in(people):
    d = I.make_dirty(people, "hard")
    f = detect_issues(d, people_rules(d, trim=True))
    rates = {r.kind: r for r in I.score_detector(f).collect()}
    assert rates["missing"].recall > 0.95 and rates["wrong_type"].recall == 1.0
    one = detect_issues(I.inject_missing(people, 0.3), people_rules(people))
    r = I.score_detector(one).filter("kind = 'missing'").first()
    assert r.precision == 1.0 and r.recall == 1.0


def test_shuffle_is_a_permutation(people):
    s = I.shuffle_rows(people)
    assert sorted(r.row_id for r in s.select("row_id").collect()) == list(range(1, 3001))
    assert s.filter("row_id = id").count() < 30


def test_uniform_sample(spark, people):
    s = K.sample_uniform(people, 50)
    assert s.count() == 50 and s.select("id").distinct().count() == 50
    with pytest.raises(Exception, match="not enough rows"):
        K.sample_uniform(people.limit(10), 50).collect()
    assert K.sample_uniform(people.limit(10), 50, strict=False).count() == 10


@pytest.mark.parametrize("fan", [3, 64])
def test_prioritized_sample(spark, monkeypatch, fan):
    monkeypatch.setattr(K, "FAN", fan)
    d = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 500, 1000.0).otherwise(1.0).alias("priority"))
    s = K.sample_prioritized(d, 3000, alpha=1.0, beta=1.0).collect()
    assert sorted(r.draw for r in s) == list(range(3000))
    hot = sum(r.row_id == 500 for r in s)
    assert 1300 < hot < 1700
    assert max(r.weight for r in s) == 1.0
    assert all(r.weight == pytest.approx(0.001) for r in s if r.row_id == 500)


def test_prioritized_sample_edges(spark):
    """Keys far apart and below zero, one row, no rows; nothing is put in order but a node's children."""
    import inspect

    far = spark.createDataFrame([(-5, 1.0), (7, 1.0), (10**12, 2.0)], "row_id long, priority double")
    seen = {}
    for r in K.sample_prioritized(far, 400, alpha=1.0).collect():
        seen[r.row_id] = seen.get(r.row_id, 0) + 1
    assert sorted(seen) == [-5, 7, 10**12] and 160 < seen[10**12] < 240
    assert K.sample_prioritized(far.limit(1), 9).count() == 9 and K.sample_prioritized(far.limit(0), 9).count() == 0
    assert "Window" not in inspect.getsource(K)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_permutations(spark, n):
    got = spark.range(n).select(*[I.permuted(F.col("id"), n, F.lit("42"), F.lit("t"), F.lit(e)).alias(f"e{e}") for e in range(3)]).collect()
    for e in range(3):
        assert sorted(r[e] for r in got) == list(range(n))
    assert n < 100 or len({tuple(r[e] for r in got) for e in range(3)}) == 3


def test_episodes_hold_duplicates_in_an_order_of_their_own(spark, people):
    few = people.limit(400)
    e = I.make_episodes(few, 3, "hard").cache()
    twice = int(400 * vocab.DIRT_LEVELS["hard"]["duplicate"])
    orders = []
    for k in range(3):
        rows = e.filter(F.col("episode") == k).orderBy("row_index").collect()
        assert [r.row_index for r in rows] == list(range(400 + twice))
        assert sum("duplicate:row" in r.truth for r in rows) == twice == len(rows) - len({r.row_id for r in rows})
        orders.append([r.row_id for r in rows])
    assert len({tuple(o) for o in orders}) == 3 and orders[0] != sorted(orders[0])


def test_pages(spark):
    d = spark.range(10).select(F.col("id").alias("row_id")).orderBy("row_id")
    assert [r.row_id for r in K.page(d, 2, 4).collect()] == [4, 5, 6, 7]
    up = spark.createDataFrame([(1, -2.0, 1), (1, 3.0, 2)], "row_id long, td_error double, seq int")
    got = K.update_priorities(spark.createDataFrame([(1, 1.0), (2, 1.0)], "row_id long, priority double"), up)
    assert [r.priority for r in got.orderBy("row_id").collect()] == [3.000001, 1.0]


def test_a_place_hashes_each_round_once(spark):
    """Rounds refer to each other's results: written out as one expression, their hashes would multiply."""
    df = spark.range(1000).select(I.permuted(F.col("id"), 1000, F.lit("tag")).alias("place"))
    assert df._jdf.queryExecution().analyzed().toString().count("md5") <= 4
    assert sorted(r.place for r in df.collect()) == list(range(1000))
