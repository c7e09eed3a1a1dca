"""Piecewise windows and quantiles against plain ones, with hot groups and narrow pieces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import history as H
from tidemark.operators.inject import kth_smallest
from tidemark.operators.quantiles import exact_quantiles, quantile_struct, select_ranks
from tidemark.operators.segments import heavy_groups, over_pieces, over_rows, with_rank, with_running


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in sorted(rnd.sample(range(5000), 900)):
        key = None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.6 else rnd.choice("abcdef")
        data.append((i, key, rnd.randint(-50, 50)))
    return spark.createDataFrame(data, "row_id long, k string, v long").cache()


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_rank_and_running(rows, width):
    w = Window.partitionBy("k").orderBy("row_id")
    want = rows.select("row_id", F.row_number().over(w).cast("long"), F.sum("v").over(w)).collect()
    ranked = with_rank(rows, ["k"], "row_id", width).select("row_id", "rank")
    running = with_running(rows, ["k"], "row_id", {"s": F.col("v")}, width).select("row_id", "s")
    assert sorted(ranked.collect()) == sorted((a, b) for a, b, _ in want)
    assert sorted(running.collect()) == sorted((a, c) for a, _, c in want)


def test_rank_without_keys(rows):
    got = with_rank(rows, [], "row_id", 50).select("row_id", "rank").orderBy("row_id").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("width", [5, 64, 10_000])
def test_frames_across_pieces(rows, width):
    w = Window.partitionBy("k").orderBy("row_id")
    exprs = {
        "back": lambda w: F.sum("v").over(w.rowsBetween(-5, -1)),
        "ahead": lambda w: F.lead("v", 2).over(w),
    }
    want = rows.select("row_id", F.sum("v").over(w.rowsBetween(-5, -1)), F.lead("v", 2).over(w)).collect()
    ranked = with_rank(rows, ["k"], "row_id", 40)
    got = over_pieces(ranked, ["k"], "rank", exprs, back=5, ahead=2, width=width).select("row_id", "back", "ahead").collect()
    key = lambda r: r[0]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("width", [50, 10_000])
def test_frames_beside_heavy_groups(rows, width):
    w = Window.partitionBy("k").orderBy("row_id")
    want = rows.select("row_id", F.sum("v").over(w.rowsBetween(-5, -1)), F.lead("v", 2).over(w), F.row_number().over(w)).collect()
    exprs = {"back": lambda w: F.sum("v").over(w.rowsBetween(-5, -1)), "ahead": lambda w: F.lead("v", 2).over(w), "nth": lambda w: F.col("r") + 0}
    got = over_rows(rows, ["k"], "row_id", exprs, back=5, ahead=2, width=width, rank="r").select("row_id", "back", "ahead", "nth").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0])


def test_exchanges_of_small_and_heavy_groups(rows):
    """Groups of up to ``width`` rows take one exchange after the count; only a heavy one is cut into pieces."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert heavy_groups(rows, ["k"], 10_000) is None
    assert [r.k for r in heavy_groups(rows, ["k"], 300).collect()] == ["hot"]
    small = plan(H.rolling_avg(rows, ["k"], "row_id", "v", 4, width=10_000))
    assert small.count("Exchange hashpartitioning") == 1 and "Join" not in small
    assert "__piece" not in small and "__piece" in plan(H.rolling_avg(rows, ["k"], "row_id", "v", 4, width=300))


def test_frame_wider_than_piece_is_refused(rows):
    with pytest.raises(ValueError):
        over_pieces(rows, ["k"], "row_id", {}, back=10, width=5)


def test_recent_reward_counts_only_earlier_rows(rows):
    d = rows.select("row_id", F.coalesce("k", F.lit("none")).alias("agent"), F.col("v").alias("reward"))
    got = H.recent_agent_reward(d, n=3, width=4)
    w = Window.partitionBy("agent").orderBy("row_id").rowsBetween(-3, -1)
    diff = got.join(d.select("row_id", F.avg("reward").over(w).alias("want")), "row_id").filter(
        ~F.col("recent_reward").eqNullSafe(F.col("want")))
    assert diff.count() == 0


@pytest.mark.parametrize("buckets", [16, 4096])
def test_exact_quantiles(spark, buckets):
    rnd = np.random.default_rng(5)
    values = np.concatenate([rnd.normal(0, 100, 3000), np.full(1500, 7.0)])  # a third of the rows share one value
    groups = rnd.integers(0, 3, len(values))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)] + [(0, None), (1, float("nan"))], "g int, v double")
    qs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.q: r.value for r in exact_quantiles(df, ["v"], qs, buckets=buckets).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(values, q), abs=1e-9)
    by = {(r.g, r.q): r.value for r in exact_quantiles(df, ["v"], qs, by=["g"], buckets=buckets).collect()}
    for g in range(3):
        for q in qs:
            assert by[g, q] == pytest.approx(np.quantile(values[groups == g], q), abs=1e-9)


@pytest.mark.parametrize("buckets", [64, 4096])
def test_quantiles_of_odd_values(spark, buckets):
    """All magnitudes, both signs, infinities, neighbours next to powers of two, and one group of 90 %."""
    rnd = random.Random(11)
    odd = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308]
    for e in (-1022, -300, -1, 0, 1, 52, 53, 700, 1023):
        odd += [math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0), -math.nextafter(math.ldexp(1.0, e), math.inf)]
    odd += [rnd.choice([-1, 1]) * math.ldexp(rnd.random(), rnd.randint(-1000, 1000)) for _ in range(300)]
    df = spark.createDataFrame([("odd", v) for v in odd] + [("hot", 3.0)] * 3000 + [(None, 1.5), (None, 2.5)], "g string, v double").repartition(5)
    ranks = select_ranks(df, ["g"], lambda n: F.sequence(F.lit(0), n - 1), False, buckets).where("g = 'odd'").collect()
    assert [r.value for r in sorted(ranks, key=lambda r: r.rank)] == sorted(odd)
    got = {r.g: r.value for r in exact_quantiles(df, ["v"], [0.5], ["g"], buckets).collect()}
    assert got["hot"] == 3.0 and got[None] == 2.0
    whole = {r.q: r.value for r in exact_quantiles(df, ["v"], [0.02, 0.5, 0.98], buckets=buckets).collect()}
    values = sorted([*odd, *[3.0] * 3000, 1.5, 2.5])
    assert whole[0.5] == 3.0 and whole[0.02] <= 3.0 <= whole[0.98] and len(values) == df.count()


def test_no_window_in_exact_quantiles():
    """Order statistics come from counts; nothing is put in order."""
    import inspect

    from tidemark.operators import inject, quantiles

    assert "Window" not in inspect.getsource(quantiles) and "Window" not in inspect.getsource(inject)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantile_struct(df, ["v"], [0.5]).first()["v_q0"] is None


@pytest.mark.parametrize("rate", [0.0001, 0.1, 0.5, 0.9, 1.0])
def test_kth_smallest(spark, rate):
    df = spark.range(1000).select((F.pmod(F.col("id") * 7919, F.lit(100_003))).cast("double").alias("h"))
    values = sorted(r.h for r in df.collect())
    k = int(1000 * rate)
    got = df.limit(1).select(kth_smallest(df, "h", rate).alias("s")).first().s
    assert got.k == k and (k == 0 or got.v == values[k - 1])
