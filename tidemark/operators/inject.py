"""Reproducible error injection with ground truth.

A cell is hit when the hash of (seed, operation, column, key) falls below the rate, so the result does
not depend on partitioning and any SQL engine can repeat it. ``exact=True`` hits exactly
floor(rows * rate) rows: those with the smallest hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import vocab
from tidemark.functions.scalars import gate, hash32, pick, uniform
from tidemark.operators.quantiles import select_ranks
from tidemark.operators.segments import with_rank

TRUTH = "truth"


def with_truth(df: DataFrame) -> DataFrame:
    """Add the empty truth column (issues put into the row)."""
    return df if TRUTH in df.columns else df.withColumn(TRUTH, F.array().cast("array<string>"))


def _hits(df: DataFrame, rate: float, op: str, column: str, seed: int, key: str, exact: bool) -> tuple[DataFrame, Column]:
    if not exact:
        return df, gate(rate, F.lit(str(seed)), F.lit(op), F.lit(column), F.col(key))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(op), F.lit(column), F.col(key).cast("string"))),
                           1, 13), 16, 10).cast("double")
    marked = df.withColumn("__h", h)
    marked = marked.withColumn("__cut", kth_smallest(marked, "__h", rate))
    return marked, (F.col("__cut.k") > 0) & (F.col("__h") <= F.col("__cut.v"))


def kth_smallest(df: DataFrame, c: str, rate: float) -> Column:
    """Struct (k, v): the k-th smallest value v of a column without nulls for k = floor(rows * rate); v is null where k is 0."""
    values = df.select(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
    found = select_ranks(values, ["column"], lambda n: F.array(F.greatest(F.floor(n * rate) - 1, F.lit(0))), True).first()
    k = math.floor(found.n * rate) if found else 0
    return F.struct(F.lit(k).cast("long").alias("k"), F.lit(found.value if k else None).cast("double").alias("v"))


@dataclass(frozen=True)
class _Error:
    """One kind of error in one column: empty cells are hit only if ``always``."""

    op: str
    column: str
    rate: float
    new: Callable[[Column], Column]
    issue: str
    always: bool = False


def _change(df: DataFrame, errors: Sequence[_Error], seed: int, key: str, exact: bool) -> DataFrame:
    """Replace the cells hit and note the issues, all columns of an operation in one projection."""
    base = df.columns
    if exact and len(errors) > 1:
        for e in errors:
            df = _change(df, [e], seed, key, exact)
        return df
    changed, noted = {}, F.col(TRUTH)
    for e in errors:
        df, hit = _hits(df, e.rate, e.op, e.column, seed, key, exact)
        c = F.col(e.column)
        hit = hit if e.always else hit & c.isNotNull()
        # the truth column is referred to once: a long chain of injections stays small when filters move through it
        noted = F.concat(noted, F.when(hit, F.array(F.lit(e.issue))).otherwise(F.array().cast("array<string>")))
        changed[e.column] = F.when(hit, e.new(c).cast(df.schema[e.column].dataType)).otherwise(c)
    out = df.withColumns({**changed, TRUTH: noted}) if errors else df
    return out.select(*base) if exact else out


def inject_missing(df: DataFrame, rate: float, cols=None, seed: int = 42, key: str = "row_id", exact: bool = False) -> DataFrame:
    cols = [c for c in (vocab.NULLABLE_COLUMNS if cols is None else cols) if c in df.columns]
    errors = [_Error("missing", c, rate * 0.5, lambda x: F.lit(None), f"missing:{c}") for c in cols]
    return _change(with_truth(df), errors, seed, key, exact)


def inject_duplicates(df: DataFrame, rate: float, seed: int = 42, key: str = "row_id", offset: int | None = None,
                      exact: bool = False) -> DataFrame:
    """Append copies under new keys (old key + offset), three in ten with the name in lower case.

    ``offset`` must lie above every key; by default the next power of ten is looked up in one aggregate.
    """
    df = with_truth(df)
    shift = F.lit(offset) if offset is not None else df.agg(
        F.pow(F.lit(10.0), F.length(F.max(key).cast("string"))).cast("bigint")).scalar()
    d, hit = _hits(df, rate, "duplicate", "row", seed, key, exact)
    copies = d.filter(hit).select(*df.columns)
    changes = {key: F.col(key) + F.col("__shift"), TRUTH: F.array_append(TRUTH, F.lit("duplicate:row"))}
    if "name" in df.columns:
        lower = gate(0.3, F.lit(str(seed)), F.lit("lower"), F.lit("name"), F.col(key))
        changes["name"] = F.when(lower, F.lower("name")).otherwise(F.col("name"))
    copies = copies.withColumn("__shift", shift).withColumns(changes).drop("__shift")
    return df.unionByName(copies)


def inject_outliers(df: DataFrame, rate: float, values=None, seed: int = 42, key: str = "row_id", exact: bool = False) -> DataFrame:
    def drawn(c: str, options: list) -> Callable[[Column], Column]:
        return lambda x: pick(options, F.lit(str(seed)), F.lit("outlier_value"), F.lit(c), F.col(key))

    values = vocab.OUTLIER_VALUES if values is None else values
    errors = [_Error("outlier", c, rate * 0.3, drawn(c, o), f"outlier:{c}", always=True)
              for c, o in values.items() if c in df.columns]
    return _change(with_truth(df), errors, seed, key, exact)


def inject_category_errors(df: DataFrame, rate: float, seed: int = 42, key: str = "row_id", exact: bool = False) -> DataFrame:
    """Typos in dept (unknown departments get an ``x``), upper or lower case in name."""
    typos = F.create_map(*[F.lit(x) for kv in vocab.DEPT_TYPOS.items() for x in kv])
    upper = gate(0.5, F.lit(str(seed)), F.lit("upper"), F.lit("name"), F.col(key))
    new = {"dept": lambda x: F.coalesce(typos[x], F.concat(x, F.lit("x"))),
           "name": lambda x: F.when(upper, F.upper(x)).otherwise(F.lower(x))}
    errors = [_Error("category", c, rate * 0.5, f, f"category:{c}") for c, f in new.items() if c in df.columns]
    return _change(with_truth(df), errors, seed, key, exact)


def inject_type_errors(df: DataFrame, rate: float, c: str = "score", seed: int = 42, key: str = "row_id",
                       exact: bool = False) -> DataFrame:
    if c not in df.columns:
        return with_truth(df)
    error = _Error("type", c, rate, lambda x: F.concat(x.cast("string"), F.lit(" points")), f"wrong_type:{c}")
    return _change(with_truth(df), [error], seed, key, exact)


def inject_formatting_errors(df: DataFrame, rate: float, seed: int = 42, key: str = "row_id", exact: bool = False) -> DataFrame:
    """E-mails with a spelled-out or doubled ending, names with a trailing blank or underscores."""
    spelled = gate(0.5, F.lit(str(seed)), F.lit("spelled"), F.lit("email"), F.col(key))
    padded = gate(0.5, F.lit(str(seed)), F.lit("padded"), F.lit("name"), F.col(key))
    new = {
        "email": lambda x: F.when(~x.contains("@"), x).when(spelled, F.replace(x, F.lit("@"), F.lit(" at ")))
        .otherwise(F.concat(x, F.lit(".com"))),
        "name": lambda x: F.when(padded, F.concat(x, F.lit(" "))).otherwise(F.replace(x, F.lit(" "), F.lit("_"))),
    }
    errors = [_Error("formatting", c, rate * 0.5, f, f"formatting:{c}") for c, f in new.items() if c in df.columns]
    return _change(with_truth(df), errors, seed, key, exact)


def make_dirty(df: DataFrame, level: str = "hard", seed: int = 42, key: str = "row_id", exact: bool = False,
               offset: int | None = None) -> DataFrame:
    """All injections of a level in fixed order, with the ``truth`` column."""
    if level not in vocab.DIRT_LEVELS:
        raise ValueError(f"unknown difficulty level: {level}")
    r = vocab.DIRT_LEVELS[level]
    out = with_truth(df)
    kw = dict(seed=seed, key=key, exact=exact)
    if r["missing"]:
        out = inject_missing(out, r["missing"], **kw)
    if r["duplicate"]:
        out = inject_duplicates(out, r["duplicate"], offset=offset, **kw)
    if r["outlier"]:
        out = inject_outliers(out, r["outlier"], **kw)
    if r["category"]:
        out = inject_category_errors(out, r["category"], **kw)
    if r["type"]:
        out = inject_type_errors(out, r["type"], **kw)
    if r["formatting"]:
        out = inject_formatting_errors(out, r["formatting"], **kw)
    return out


def people_table(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Clean people: every column a function of the row number, generated where it is needed."""
    ids = spark.range(1, n + 1, 1, partitions) if partitions else spark.range(1, n + 1)
    s = F.lit(str(seed))

    def bell(tag: str, mean: float, dev: float, lo: int, hi: int) -> Column:
        u1 = F.greatest(uniform(s, F.lit(tag + "1"), F.col("id")), F.lit(1e-9))
        u2 = uniform(s, F.lit(tag + "2"), F.col("id"))
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)
        return F.greatest(F.lit(lo), F.least(F.lit(hi), (mean + dev * z).cast("bigint"))).cast("bigint")

    lo = F.create_map(*[F.lit(x) for k, v in vocab.SALARY_RANGES.items() for x in (k, v[0])])
    hi = F.create_map(*[F.lit(x) for k, v in vocab.SALARY_RANGES.items() for x in (k, v[1])])
    d = ids.select(
        F.col("id").alias("row_id"), F.col("id"),
        pick(vocab.NAME_OPTIONS, s, F.lit("name"), F.col("id")).alias("name"),
        bell("age", 35, 10, 18, 70).alias("age"),
        pick(vocab.DEPT_OPTIONS, s, F.lit("dept"), F.col("id")).alias("dept"),
        bell("score", 75, 15, 0, 100).cast("string").alias("score"),
        (F.pmod(hash32(s, F.lit("number"), F.col("id")), F.lit(99)) + 1).alias("__no"),
        pick(vocab.EMAIL_DOMAINS, s, F.lit("domain"), F.col("id")).alias("__domain"),
        uniform(s, F.lit("salary"), F.col("id")).alias("__u"),
    )
    salary = (lo[F.col("dept")] + (hi[F.col("dept")] - lo[F.col("dept")]) * F.col("__u")).cast("bigint")
    email = F.concat(F.lower("name"), F.lit("."), F.col("__no").cast("string"), F.lit("@"), F.col("__domain"))
    return d.select("row_id", "id", "name", "age", salary.alias("salary"), "score", "dept", email.alias("email"))


#: Half rounds of a permutation, and times that a value may leave the range before it is given up.
ROUNDS, WALKS = 4, 32


def permuted(x: Column, n: int, *tag: Column) -> Column:
    """The place of x in a permutation of 0..n-1 that the tag picks: nothing is sorted, each row finds its own place.

    A Feistel network on the smallest rectangle that holds n: row and column are shifted in turn by a hash of the other. Fewer than a
    row of its cells lie beyond n; a value that lands there goes through the network again.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = -(-max(n, 1) // a)

    def turned(at: Column, r: Column) -> Column:
        row, col = at["row"], at["col"]
        return F.when(r % 2 == 0, F.struct(((row + hash32(*tag, r, col)) % a).alias("row"), col.alias("col"))).otherwise(
            F.struct(row.alias("row"), ((col + hash32(*tag, r, row)) % b).alias("col")))

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b)).cast("long").alias("row"), (v % b).cast("long").alias("col"))
        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turned, lambda at: at["row"] * b + at["col"])

    def given(v: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is worked out once, however often it is used."""
        return F.get(F.transform(F.array(v), then), F.lit(0))

    def again(v: Column) -> Column:
        return F.when(v < n, v).otherwise(once(v))

    walked = given(once(x.cast("long")), lambda v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), v, lambda w, _: again(w))))
    return given(walked, lambda w: F.when(w < n, w).otherwise(F.raise_error(F.lit("no place in the permutation")).cast("long")))


def make_episodes(df: DataFrame, n: int, level: str = "hard", key: str = "row_id", rate: float | None = None, seed: int = 42) -> DataFrame:
    """n dirty copies of the table, each hit by its own hashes and in its own order: columns ``episode`` 0..n-1 and ``row_index`` from 0.

    The row key of a copy is ``episode:key``, so every injection draws anew in every episode. The level's share of rows, rounded
    down, stands twice in an episode, three in ten of the second ones with the name in lower case. Both the choice of these and the
    order of an episode's rows are permutations of row numbers, so an episode costs no sort; the table is numbered once.
    """
    rows = with_rank(df, [], key, name="__place").withColumn("__place", F.col("__place") - 1)
    size = rows.count()
    r = vocab.DIRT_LEVELS[level]
    twice = math.floor(size * r["duplicate"])
    s = F.lit(str(seed))
    many = rows.withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "episode_key", F.concat_ws(":", F.col("episode").cast("string"), F.col(key).cast("string")))
    kw = dict(key="episode_key", seed=seed)
    out = inject_missing(many, r["missing"] if rate is None else rate, **kw)
    if twice:
        copies = out.withColumn("__nth", permuted(F.col("__place"), size, s, F.lit("duplicate"), F.col("episode"))).where(F.col("__nth") < twice)
        changes = {"episode_key": F.concat("episode_key", F.lit(":copy")), "__place": F.col("__nth") + size,
                   TRUTH: F.array_append(TRUTH, F.lit("duplicate:row"))}
        if "name" in df.columns:
            lower = gate(0.3, s, F.lit("lower"), F.lit("name"), F.col("episode_key"))
            changes["name"] = F.when(lower, F.lower("name")).otherwise(F.col("name"))
        out = out.unionByName(copies.withColumns(changes).drop("__nth"))
    out = inject_outliers(out, r["outlier"], **kw)
    out = inject_category_errors(out, r["category"], **kw)
    out = inject_type_errors(out, r["type"], **kw)
    out = inject_formatting_errors(out, r["formatting"], **kw)
    return out.withColumn("row_index", permuted(F.col("__place"), size + twice, s, F.lit("order"), F.col("episode"))).drop("__place")


def shuffle_rows(df: DataFrame, seed: int = 42, key: str = "row_id", name: str = "row_id", width: int = 2**24) -> DataFrame:
    """New row numbers 1..n in the order of the keys' md5 (its first 52 bits; keys that share them come in some order).
    No global sort in one task."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), F.col(key).cast("string")).cast("binary"))
    h = df.withColumn("__h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    return with_rank(h, [], "__h", width=width * 2**8, name="__new").withColumn(name, F.col("__new")).drop("__h", "__new")


def score_detector(df: DataFrame, truth: str = TRUTH, found: str = "issues") -> DataFrame:
    """Precision, recall and F1 per issue kind from two issue arrays of the same row: no exchange but the counts."""
    flags = F.transform(F.array_union(truth, found), lambda x: F.struct(
        F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"), F.array_contains(F.col(truth), x).cast("int").alias("t"),
        F.array_contains(F.col(found), x).cast("int").alias("f")))
    return _detector_rates(df.select(F.inline(flags)))


def score_detector_tables(truth: DataFrame, found: DataFrame) -> DataFrame:
    """The same from two long tables (row_id, kind, column)."""
    cols = ["row_id", "kind", "column"]
    both = truth.select(*cols, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(
        found.select(*cols, F.lit(0).alias("t"), F.lit(1).alias("f")))
    return _detector_rates(both.groupBy(*cols).agg(F.max("t").alias("t"), F.max("f").alias("f")))


def _detector_rates(cells: DataFrame) -> DataFrame:
    k = cells.groupBy("kind").agg(
        F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("hits"),
        F.sum("t").alias("in_truth"), F.sum("f").alias("in_found"))
    p = F.when(F.col("in_found") > 0, F.col("hits") / F.col("in_found")).otherwise(F.lit(0.0))
    r = F.when(F.col("in_truth") > 0, F.col("hits") / F.col("in_truth")).otherwise(F.lit(0.0))
    return k.select("kind", "hits", "in_truth", "in_found", p.alias("precision"), r.alias("recall"),
                    F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))
