"""Ratio, lossless bounds and near-duplicates against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import similarity as X
from tidemark.operators import fuzzy as Z


def words(n, seed, alphabet="abcde ", longest=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_ratio_and_bounds(spark):
    pairs = list(zip(words(600, 1), words(600, 2))) + [("tide", "diet"), ("diet", "tide"), ("", ""), ("é", "e")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", X.ratio_udf()(a, b).alias("r"), X.edit_bound(a, b).alias("e"), X.length_bound(a, b).alias("l")).collect():
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == want and want <= r.e + 1e-12 and want <= r.l + 1e-12


@pytest.mark.parametrize("t", [0.5, 0.7, 0.9])
def test_matches_share_a_prefix_token(spark, t):
    texts = words(150, 3)
    df = spark.createDataFrame([(w,) for w in texts], "w string").select("w", X.prefix_tokens(F.col("w"), t).alias("p"))
    tokens = [(r.w, set(r.p)) for r in df.collect()]
    for a, pa in tokens:
        for b, pb in tokens:
            if SequenceMatcher(None, a, b).ratio() >= t:
                assert pa & pb, (a, b)


def brute(rows, cols, block, t):
    out = {}
    for i, r in enumerate(rows):
        best = 0.0
        for p in rows[:i]:
            if p[block] == r[block]:
                best = max(best, sum(SequenceMatcher(None, str(r[c]), str(p[c])).ratio() for c in cols) / len(cols))
        if best >= t:
            out[r["row_id"]] = best
    return out


@pytest.mark.parametrize("t", [0.7, 0.85, 1.0])
def test_fuzzy_duplicates_equal_brute_force(spark, t):
    rnd = random.Random(7)
    base = words(60, 5, "abcdefgh", 10)
    rows = []
    for i in range(260):
        name = rnd.choice(base) if rnd.random() < 0.6 else None if rnd.random() < 0.1 else rnd.choice(base)[:-1] + rnd.choice("xyz")
        city = rnd.choice(["rome", "roma", "paris"])
        if rnd.random() < 0.33:
            name, city = "copycat", "rome"  # a third of the rows are one group of copies
        rows.append({"row_id": i, "name": name, "city": city, "g": rnd.choice("pq")})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, name string, city string, g string")
    got = {r.row_id: r.similarity for r in Z.fuzzy_duplicates(df, ["name", "city"], [F.col("g")], threshold=t).collect()}
    want = brute(rows, ["name", "city"], "g", t)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def expanded(found):
    """All pairs of rows, copies written out."""
    first = {r.row_id: r.other_id for r in found if r["copy"]}
    sets = {}
    for r in found:
        for i in (r.row_id, r.other_id):
            sets.setdefault(first.get(i, i), set()).add(i)
    out = {}
    for r in found:
        if not r["copy"]:
            for i in sets[r.row_id]:
                for j in sets[r.other_id]:
                    out[max(i, j), min(i, j)] = r.similarity
    for own in sets.values():
        out |= {(i, j): 1.0 for i in own for j in own if i > j}
    return out


@pytest.mark.parametrize("t", [0.4, 0.8])
def test_candidate_pairs_are_the_matches(spark, t):
    texts = words(120, 9, "abcd", 8)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, w string")
    rows = Z.candidate_pairs(df, "w", [], t).collect()
    assert len(rows) == len({(r.row_id, r.other_id) for r in rows})
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(x, i)
    # the ratio depends on the order: that of the first rows of both sets counts
    want = {}
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            x, y = (a, b) if first[a] > first[b] else (b, a)
            r = SequenceMatcher(None, x, y).ratio()
            if r >= t:
                want[i, j] = r
    assert expanded(rows) == {k: pytest.approx(v) for k, v in want.items()}


def test_wide_columns_with_many_equal_characters(spark, monkeypatch):
    """Texts that run over the words of bits, no narrow column, pieces of few rows."""
    monkeypatch.setattr(Z, "NARROW", 0)
    monkeypatch.setattr(Z, "PIECE", 20)
    rnd = random.Random(6)
    rows = [{"row_id": i, "g": 0, "a": "".join(rnd.choice("aab\u00e9\u4e2d") for _ in range(rnd.randint(0, 40))), "b": rnd.choice([None, "", "x" * 30, "xy" * 9])}
            for i in range(130)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g int, a string, b string")
    got = {r.row_id: r.similarity for r in Z.fuzzy_duplicates(df, ["a", "b"], threshold=0.8).collect()}
    want = brute(rows, ["a", "b"], "g", 0.8)
    assert want and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_sql_name(spark):
    X.register(spark)
    assert spark.sql("SELECT ratcliff_ratio('tide', 'diet')").first()[0] == 0.25


@pytest.mark.parametrize("t", [0.3, 0.7])
def test_fuzzy_duplicates_over_four_columns_without_a_block(spark, t):
    """Four columns at 0.7 leave no bound on any single one; texts may be empty."""
    rnd = random.Random(4)
    pools = [words(25, s, "abcdefghij", 9) + [None] for s in range(4)]
    rows = [{"row_id": i, "g": 0, **{c: rnd.choice(pools[k]) for k, c in enumerate("abcd")}} for i in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g int, a string, b string, c string, d string")
    got = {r.row_id: r.similarity for r in Z.fuzzy_duplicates(df, list("abcd"), threshold=t).collect()}
    want = brute(rows, list("abcd"), "g", t)
    assert want and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_registered_queries_keep_every_match(spark):
    from tidemark.queries import base as B, catalog

    sf = "/root/testdata/sf0.001"
    cols = ["id", "name", "age", "salary", "score", "dept", "email"]
    d = B.dirty(spark, sf, "medium").select("row_id", *cols)
    rows = [r.asDict() | {"g": 0} for r in d.orderBy("row_id").collect()]
    got = {r.row_id: r.similarity for r in catalog.QUERIES["fuzzy_duplicates"](spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in brute(rows, cols, "g", 0.7).items()}
    pairs = expanded(catalog.QUERIES["candidate_pairs"](spark, sf).collect())
    for i, a in enumerate(rows):
        for b in rows[:i]:
            mean = sum(SequenceMatcher(None, str(a[c]), str(b[c])).ratio() for c in cols) / len(cols)
            assert ((a["row_id"], b["row_id"]) in pairs) == (mean >= 0.7)


def test_few_pairs_meet(spark):
    from tidemark.queries import base as B

    t, reps, texts = Z._folded(B.dirty(spark, "/root/testdata/sf0.01", "medium"), ["id", "name", "age", "salary", "score", "dept", "email"], (), "row_id")
    n, met = reps.count(), Z.meeting_pairs(reps, texts, 0.7).count()
    print(f"{met} of {n * (n - 1) // 2} pairs meet")
    assert met < 0.01 * n * (n - 1) / 2


def test_best_matches_without_all_that_reach_the_threshold(spark, monkeypatch):
    """The best sums known so far decide what is looked at, not the threshold alone; several places, pieces and stretches."""
    monkeypatch.setattr(Z, "meeting_pairs", None)
    for name, value in {"PIECE": 15, "PASSING": 70, "CLASSES": 9, "NEIGHBOURS": 2}.items():
        monkeypatch.setattr(Z, name, value)
    rnd = random.Random(8)
    pools = {"a": words(3, 1), "b": words(12, 2), "c": words(700, 3, "abcdefghij", 12)}
    rows = [{"row_id": i, "g": i % 2, **{c: rnd.choice([*pool, None]) for c, pool in pools.items()}} for i in range(220)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id int, g int, a string, b string, c string")
    out = Z.fuzzy_duplicates(df, list("abc"), [F.col("g")], threshold=0.6)
    want = brute(rows, list("abc"), "g", 0.6)
    assert dict(out.dtypes)["row_id"] == "int" and want
    assert {r.row_id: r.similarity for r in out.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_remembered_ratios_are_bounded(monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 5)
    ratio = X.matcher()()
    for i in range(50):
        ratio(f"{i}x", "x")
    assert len(ratio.__closure__[[c for c in ratio.__code__.co_freevars].index("seen")].cell_contents) <= 5


def test_many_ratios_at_once_equal_single_ones():
    import numpy as np

    rnd = random.Random(12)
    texts = words(160, 11, "ab", 20) + words(160, 13, "abcdefgé中\U0001f600", 64) + ["", "x" * 64, "x" * 65, "ab" * 150, "".join(rnd.choice("abc") for _ in range(260))]
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    i, j = (np.array([rnd.randrange(len(texts)) for _ in range(5_000)] + list(range(len(texts) - 5, len(texts))) * 5) for _ in "ab")
    want = [SequenceMatcher(None, texts[x], texts[y]).ratio() for x, y in zip(i, j)]
    points = np.array([ord(c) for t in texts for c in t])
    alphabet, ranks = np.unique(points, return_inverse=True)
    ratios = X.batch_matcher()()
    assert ratios(points, start[i], size[i], start[j], size[j]).tolist() == want
    assert ratios(ranks.astype(np.uint8), start[i], size[i], start[j], size[j]).tolist() == want


@pytest.mark.parametrize("narrow", [0, 5, 500])
def test_pairs_of_all_pieces_are_met(spark, monkeypatch, narrow):
    """Pieces that share a block, hold several or lie within one; texts empty, missing or longer than what is compared in arrays."""
    for name, value in {"NARROW": narrow, "TILE": 40, "TOGETHER": (16, 4)}.items():
        monkeypatch.setattr(Z, name, value)
    rnd = random.Random(14)
    pools = {"a": words(4, 1), "b": words(40, 2, "abcdefgh中", 9), "c": ["", None, *words(30, 3, "ab", 90)]}
    rows = [{"row_id": i * 7 % 401, "g": rnd.choice("pppqrs") if i % 9 else f"g{i % 5}", **{c: rnd.choice(pool) for c, pool in pools.items()}} for i in range(400)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g string, a string, b string, c string")
    got = expanded(Z.candidate_pairs(df, list("abc"), [F.col("g")], 0.62).collect())
    rows.sort(key=lambda r: r["row_id"])
    first, want = {}, {}
    for i, x in enumerate(rows):
        first.setdefault((x["g"], x["a"], x["b"], x["c"]), i)
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x["g"] == y["g"]:
                late, early = sorted((x, y), key=lambda r: -first[r["g"], r["a"], r["b"], r["c"]])
                s = sum(SequenceMatcher(None, str(late[c]), str(early[c])).ratio() for c in "abc") / 3
                if s >= 0.62:
                    want[x["row_id"], y["row_id"]] = s
    assert want and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_a_row_is_copied_once_per_piece_at_most(spark):
    """The rows that meet are dealt out by pieces of the table, not by combinations of narrow texts."""
    from tidemark.queries import base as B

    t, reps, texts = Z._folded(B.dirty(spark, "/root/testdata/sf0.01", "medium"), ["id", "name", "age", "salary", "score", "dept", "email"], (), "row_id")
    met = Z.meeting_pairs(reps, texts, 0.7, "similarity")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and "cls" not in plan and "stretch" not in plan


@pytest.mark.parametrize("best", [False, True])
def test_pieces_meet_without_copies_of_their_rows_on_disk(spark, monkeypatch, best):
    """Nothing is shuffled where pieces meet, so no row is written once per piece."""
    from tidemark.queries import base as B

    seen = []
    for name in ("TILE", "PIECE"):
        monkeypatch.setattr(Z, name, 40)
    monkeypatch.setattr(Z, "_met", lambda *a, real=Z._met: seen.append(real(*a)) or seen[-1])
    d = B.dirty(spark, "/root/testdata/sf0.001", "medium")
    (Z.fuzzy_duplicates if best else Z.candidate_pairs)(d, ["id", "name", "age", "salary", "score", "dept", "email"])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().splitlines()
    places = [n for n, line in enumerate(plan) if "CartesianProduct" in line]
    assert places and all(n > places[0] for n, line in enumerate(plan) if "Exchange" in line)
    assert all("rangepartitioning(" in line for line in plan if "Exchange" in line)


@pytest.mark.parametrize("dear", [0, 10**6])
def test_products_and_single_pairs_find_the_same(spark, monkeypatch, dear):
    """Near pairs are looked at singly where they are few and by products of matrices where they are many: either way all are found."""
    monkeypatch.setattr(Z, "TOGETHER", (16, dear))
    rnd = random.Random(21)
    pools = {"a": words(4, 1), "b": words(600, 2, "abcdefgh中", 9), "c": [None, *words(700, 3, "abc", 30)]}
    rows = [{"row_id": i, "g": 0, **{c: rnd.choice(pool) for c, pool in pools.items()}} for i in range(420)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g int, a string, b string, c string")
    monkeypatch.setattr(Z, "NARROW", 50)
    want = brute(rows, list("abc"), "g", 0.55)
    got = {r.row_id: r.similarity for r in Z.fuzzy_duplicates(df, list("abc"), threshold=0.55).collect()}
    assert len(want) > 100 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    best = {}
    for (i, _), s in expanded(Z.candidate_pairs(df, list("abc"), threshold=0.55).collect()).items():
        best[i] = max(best.get(i, 0), s)
    assert best == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
