"""Exact order statistics by distributed radix selection: nothing is sorted, and no task holds more than counts.

Doubles map to whole numbers of the same order. A round deals the values of the bracket in which a wanted rank lies into a
fixed number of equal stretches, counts each - partial sums, so equal values and hot groups fold before the exchange - and
keeps the stretch that holds the rank, shrunk to the smallest and largest value met in it. The bracket of a rank is done when
both are one value: after one round where values are few, after four at 10**12 values, after six in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.segments import null_safe
from tidemark.session import cut

BUCKETS = 4_096
#: Accuracy of the sketches that stand in for exact quantiles on request.
ACCURACY = 20_000

# layout of a double: bits of the fraction, the exponents of normal numbers and what is added to them
FRACTION, LOWEST, HIGHEST, BIAS = 52, -1022, 1023, 1023


def with_order_key(df: DataFrame, v: str, name: str) -> DataFrame:
    """Add a long that rises with the double, one for each value: exponent and fraction side by side, signed. Not for NaN."""
    a, e, unit = F.abs(v), F.col("__e"), F.lit(float(2**FRACTION))
    rough = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(F.when(a < float("inf"), a)))))
    out = df.withColumn("__e", F.when(a > 0, F.coalesce(rough, F.lit(HIGHEST))).otherwise(F.lit(LOWEST)).cast("int"))
    # a rounded logarithm may be off by one next to a power of two
    power = F.pow(F.lit(2.0), e)
    out = out.withColumn("__e", F.when((power > a) & (e > LOWEST), e - 1).when((power <= a / 2) & (e < HIGHEST), e + 1).otherwise(e))
    fraction = ((a / F.pow(F.lit(2.0), e) - 1.0) * unit).cast("long")
    size = F.when(a == float("inf"), F.lit((HIGHEST + BIAS + 1) << FRACTION)).when(a == 0, F.lit(0)).otherwise(
        (e + BIAS).cast("long") * F.lit(1 << FRACTION) + F.when(a < float("inf"), fraction))
    return out.withColumn(name, F.when(F.col(v) < 0, -size).otherwise(size)).drop("__e")


def _bucket(k: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """The number of the key's stretch among ``buckets`` between two keys. Half keys, as the whole range doesn't fit in a long."""
    h, hlo, hhi = (F.shiftright(x, 1) for x in (k, lo, hi))
    width = F.call_function("div", hhi - hlo, F.lit(buckets)) + 1
    return F.when(hlo == hhi, k - lo).otherwise(F.call_function("div", h - hlo, width))


def select_ranks(values: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Column], few: bool, buckets: int = BUCKETS,
                 weight: str | None = None) -> DataFrame:
    """(keys, n, rank, value): the values at 0-based ranks of each group of ``values`` (keys, v; no null, no NaN).

    A row stands for ``weight`` equal values. ``ranks`` makes an array of ranks from the group's number of values ``n``. Groups may be of any size. Where they are
    ``few`` - columns of a table - a row per rank stays with the driver between rounds, else in the shared folder.
    """
    keys = list(keys)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    state = values.groupBy(*keys).agg(times.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    state = state.select(*keys, "n", F.explode(F.array_distinct(ranks(F.col("n")).cast("array<long>"))).alias("rank"), "lo", "hi").select(
        *keys, "n", "rank", F.col("rank").alias("left"), "lo", "hi")

    def kept(state: DataFrame) -> tuple[DataFrame, bool]:
        if not few:
            state = cut(state, "ranks")
            return state, not state.where("lo < hi").isEmpty()
        rows = state.collect()
        return state.sparkSession.createDataFrame(rows, state.schema), any(r.lo < r.hi for r in rows)

    state, more = kept(state)
    while more:
        open_ = state.where("lo < hi").select(*keys, "lo", "hi").distinct()
        open_ = with_order_key(with_order_key(open_, "lo", "__klo"), "hi", "__khi")
        met = null_safe(values, F.broadcast(open_) if few else open_, keys, "inner")
        met = with_order_key(met.where(F.col("v").between(F.col("lo"), F.col("hi"))), "v", "__k")
        counts = met.groupBy(*keys, "lo", "hi", _bucket(F.col("__k"), F.col("__klo"), F.col("__khi"), buckets).alias("__b")).agg(
            times.alias("c"), F.min("v").alias("l"), F.max("v").alias("h"))
        # at most ``buckets`` entries and one
        tables = counts.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("__b", "c", "l", "h"))).alias("__t"))
        found = F.aggregate("__t", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("l"),
                                            F.lit(None).cast("double").alias("h")), _step)
        state = null_safe(state, tables, [*keys, "lo", "hi"], "left").withColumn("__f", F.when(F.col("__t").isNotNull(), found)).select(
            *keys, "n", "rank", (F.col("left") - F.coalesce("__f.before", F.lit(0))).alias("left"), F.coalesce("__f.l", "lo").alias("lo"),
            F.coalesce("__f.h", "hi").alias("hi"))
        state, more = kept(state)
    return state.select(*keys, "n", "rank", F.col("lo").alias("value"))


def _step(at: Column, x: Column) -> Column:
    here = (at["seen"] <= F.col("left")) & (F.col("left") < at["seen"] + x["c"])
    return F.struct((at["seen"] + x["c"]).alias("seen"), F.when(here, at["seen"]).otherwise(at["before"]).alias("before"),
                    F.when(here, x["l"]).otherwise(at["l"]).alias("l"), F.when(here, x["h"]).otherwise(at["h"]).alias("h"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                    buckets: int = BUCKETS) -> DataFrame:
    """One row per column, quantile (and group): ``column, q, n, value`` plus the ``by`` columns, linearly interpolated.

    NULL and NaN don't count; columns without any value yield no row.
    """
    by = list(by)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in dict.fromkeys(cols)]
    values = df.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    return weighted_quantiles(values, [*by, "column"], qs, None, not by, buckets)


def weighted_quantiles(values: DataFrame, keys: Sequence[str], qs: Sequence[float], weight: str | None, few: bool, buckets: int = BUCKETS) -> DataFrame:
    """``keys, q, n, value`` of ``values`` as :func:`select_ranks` takes them, linearly interpolated."""
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    both = [f(p).cast("long") for p in places for f in (F.floor, F.ceil)]
    found = select_ranks(values, keys, lambda n: F.array(*both), few, buckets, weight)
    tables = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__m"))

    def at(p: Column) -> Column:
        lo, hi = (F.element_at("__m", f(p).cast("long")) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (p - F.floor(p))

    return tables.select(*keys, "n", F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), at(p).alias("value")) for q, p in zip(qs, places)])).alias("x")).select(*keys, "x.q", "n", "x.value")


def quantile_struct(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                    method: str = "exact") -> DataFrame:
    """One row (per group) with a column ``<col>_q<i>`` for the i-th quantile of each column."""
    by = list(by)
    names = {(c, i): f"{c}_q{i}" for c in cols for i in range(len(qs))}
    if method == "approx":
        aggs = [F.percentile_approx(c, float(q), ACCURACY).cast("double").alias(names[c, i])
                for c in cols for i, q in enumerate(qs)]
        return df.groupBy(*by).agg(*aggs)
    long = exact_quantiles(df, cols, qs, by)
    aggs = [F.max(F.when((F.col("column") == c) & (F.col("q") == float(q)), F.col("value"))).alias(names[c, i])
            for c in cols for i, q in enumerate(qs)]
    return long.groupBy(*by).agg(*aggs)


def attach_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                     method: str = "exact") -> tuple[DataFrame, dict[tuple[str, int], Column]]:
    """The frame with the quantiles beside every row, and the columns that hold them.

    Without groups the values come in as a scalar subquery; with groups by a join on the group keys.
    """
    stats = quantile_struct(df, cols, qs, by, method)
    names = [f"{c}_q{i}" for c in cols for i in range(len(qs))]
    if by:
        out = null_safe(df, stats.withColumnsRenamed({n: f"__{n}" for n in names}), by, "left")
        return out, {(c, i): F.col(f"__{c}_q{i}") for c in cols for i in range(len(qs))}
    out = df.withColumn("__stats", stats.select(F.struct(*names)).scalar())
    return out, {(c, i): F.col(f"__stats.{c}_q{i}") for c in cols for i in range(len(qs))}
