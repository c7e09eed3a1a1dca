"""Paging and sampling; reproducible by hash where chance is involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import hash32
from tidemark.session import cut


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest first: by start, else creation, else the epoch; then by id."""
    stamp = F.coalesce("started_at", "created_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return jobs.orderBy(stamp.desc(), F.col("job_id").asc())


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return df.offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def preview(df: DataFrame, order: str = "row_id", n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample_uniform(df: DataFrame, n: int, seed: int = 42, key: str = "row_id", strict: bool = True) -> DataFrame:
    """n rows without replacement: those with the smallest hashes. Fails if there are fewer, unless not ``strict``."""
    drawn = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    drawn = drawn.orderBy("__h", key).limit(n)
    if strict:
        have = drawn.agg(F.count(F.lit(1))).scalar()
        enough = F.when(have >= n, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"not enough rows to sample {n}")).cast("boolean"))
        drawn = drawn.filter(enough)
    return drawn.drop("__h")


#: Children of a node of the sum tree, and the height of the nodes that one scan adds up.
FAN, LEAVES = 64, 3


def _level(totals: DataFrame) -> DataFrame:
    """(__node, __children): the nodes above those of ``totals`` (__at, __sum), each with its up to FAN children in order."""
    return totals.groupBy(F.call_function("div", "__at", F.lit(FAN)).alias("__node")).agg(
        F.array_sort(F.collect_list(F.struct("__at", "__sum"))).alias("__children"))


def _descend(draws: DataFrame, level: DataFrame, small: bool) -> DataFrame:
    """Each draw (draw, __node, __off) goes to the child whose stretch its offset falls into."""
    zero = F.lit(0).cast("decimal(38,0)")

    def step(at: Column, x: Column) -> Column:
        here = (F.col("__off") >= at["seen"]) & (F.col("__off") < at["seen"] + x["__sum"])
        seen = (at["seen"] + x["__sum"]).cast("decimal(38,0)")
        return F.struct(seen.alias("seen"), F.when(here, x["__at"]).otherwise(at["node"]).alias("node"),
                        F.when(here, (F.col("__off") - at["seen"]).cast("decimal(38,0)")).otherwise(at["off"]).alias("off"))

    start = F.struct(zero.alias("seen"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("decimal(38,0)").alias("off"))
    joined = draws.join(F.broadcast(level) if small else level, "__node").withColumn("__c", F.aggregate("__children", start, step))
    return joined.select("draw", F.col("__c.node").alias("__node"), F.col("__c.off").alias("__off"))


def sample_prioritized(df: DataFrame, n: int, alpha: float = 0.6, beta: float = 0.4, seed: int = 42,
                       key: str = "row_id", priority: str = "priority") -> DataFrame:
    """n draws with replacement, probability proportional to priority^alpha; ``weight`` corrects the bias. Keys are unique integers.

    Chances are whole numbers (units of 1e-6), so sums are exact however they are added up. They are the leaves of a tree in the
    order of the keys: a node stands for a stretch of keys, FAN times as long as its children's, and holds their sums. One scan adds
    up the nodes of height LEAVES, those above follow from them, those below are worked out only where draws arrive. All
    draws go down a level at a time by an equi-join on their node. An empty table gives no draws.
    """
    d = df.withColumn("__chance", F.greatest(F.round(F.pow(F.col(priority), alpha) * 1e6), F.lit(1)).cast("decimal(20,0)"))
    head = d.agg(F.sum("__chance").cast("decimal(38,0)").alias("total"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    total, count = F.lit(head.total or 0).cast("decimal(38,0)"), head.n
    d = d.withColumn("__key", F.col(key) - F.lit(head.lo or 0))
    height = 1
    while FAN**height <= (head.hi or 0) - (head.lo or 0):
        height += 1
    u = (hash32(F.lit(str(seed)), F.lit("draw"), F.col("draw")).cast("decimal(20,0)") * F.lit(2**20)
         + F.pmod(hash32(F.lit(str(seed)), F.lit("draw_low"), F.col("draw")), F.lit(2**20))).cast("decimal(17,0)")
    share = u.cast("double") / float(2**52)
    draws = df.sparkSession.range(n if count else 0).select(F.col("id").alias("draw")).select(
        "draw", F.lit(0).cast("long").alias("__node"), F.floor(share * total.cast("double")).cast("decimal(38,0)").alias("__off"))

    def sums(rows: DataFrame, at: Column) -> DataFrame:
        return rows.groupBy(at.cast("long").alias("__at")).agg(F.sum("__chance").cast("decimal(38,0)").alias("__sum"))

    def node(c: str, levels: int) -> Column:
        return F.call_function("div", F.col(c), F.lit(FAN**levels))

    low = min(height, LEAVES)
    if height > LEAVES:
        pieces = cut(sums(d, node("__key", LEAVES)), "pieces")
        for h in range(height - 1, LEAVES - 1, -1):
            level = _level(pieces.groupBy(node("__at", h - LEAVES).cast("long").alias("__at")).agg(F.sum("__sum").cast("decimal(38,0)").alias("__sum")))
            draws = _descend(draws, level, h >= height - 2)  # the two highest levels have FAN nodes at most
    rows = d
    for h in range(low - 1, -1, -1):
        draws = cut(draws, "draws")
        there = draws.select(F.col("__node").alias("__hit")).distinct()
        rows = rows.join(there, node("__key", h + 1).cast("long") == F.col("__hit"), "left_semi")
        draws = _descend(draws, _level(sums(rows, node("__key", h))), False)
    hit = draws.select("draw", "__node").join(rows, F.col("__node") == F.col("__key"))
    p = F.col("__chance").cast("double") / total.cast("double")
    weighted = cut(hit.withColumn("__w", F.pow(F.lit(count) * p, -beta)).select("draw", *df.columns, "__w"), "drawn")
    top = weighted.agg(F.max("__w")).scalar()
    return weighted.select("draw", *df.columns, (F.col("__w") / top).alias("weight"))


def update_priorities(df: DataFrame, updates: DataFrame, key: str = "row_id", priority: str = "priority",
                      error: str = "td_error") -> DataFrame:
    """New priority |error| + 1e-6 for the rows that have one (the last, by ``seq``, if there are several)."""
    cols = [key, error] + (["seq"] if "seq" in updates.columns else [])
    latest = updates.select(*cols)
    if "seq" in cols:
        latest = latest.groupBy(key).agg(F.max_by(error, "seq").alias(error))
    u = latest.select(F.col(key).alias("__key"), (F.abs(error) + 1e-6).alias("__new"))
    out = df.join(u, df[key] == u["__key"], "left")
    return out.withColumn(priority, F.coalesce("__new", priority)).drop("__key", "__new")
