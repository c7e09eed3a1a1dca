"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import FILTER_BITS, ascii_lower, keyed, may_repeat, set_aside, without
from tidemark.session import cut

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None,
                bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, full_hash, and the ``extra`` columns.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays. ``full_hash`` is null where length or prefix settled it already: the whole
    text is hashed only for rows that still share both with another row. ``extra`` columns are computed where
    the rows are read, so that they travel along without the text.

    Each level counts its keys with partial sums and hands the repeated ones to the next scan as a bitmap of
    fixed size, so no text is ever shuffled, and a group of any size is a sum of partial sums.

    Repeated rows with one id share their decision (all are kept if that id stays). A null id loses against
    any other; a group of null ids only keeps them all. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"),
                       *[c.alias(k) for k, c in (extra or {}).items()])
    base = base.withColumn("__len", F.octet_length("__text"))
    level1 = may_repeat(base, ["__len"], base, "__again", bits).withColumn(
        "__prefix", F.when(F.col("__again"), F.xxhash64(ascii_lower(F.substring("__text", 1, PREFIX_CHARS)))))
    level2 = may_repeat(level1, ["__len", "__prefix"], level1.where("__again"), "__twice", bits).withColumn(
        "full_hash", F.when(F.col("__again") & F.col("__twice"), F.sha2(ascii_lower(F.col("__text")), 256)))
    slim = cut(level2.select("doc_id", "full_hash", *(extra or {})), "dedup")
    groups = slim.where("full_hash IS NOT NULL").groupBy("full_hash").agg(
        F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    # a row that is settled gets a key of its own: null keys would all meet in one task
    own = F.concat(F.lit("#"), F.xxhash64("doc_id").cast("string"))
    return (slim.withColumn("__key", F.coalesce("full_hash", own))
            .join(groups.withColumnRenamed("full_hash", "__key"), "__key", "left")
            .select("doc_id", F.coalesce("__keep", "doc_id").alias("keep_id"),
                    F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
                    F.coalesce("__keep", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
                    "full_hash", *(extra or {})))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """The rows that stay, with all their columns: one of a group. A row without an id can't be named, so it stays where no
    row with an id has its text. ``docs`` is read several times; of its texts hardly more are shuffled than those that go."""
    docs, back = set_aside(docs, id_col, text_col)
    rows = keyed(docs, id_col, bits)
    found = cut(exact_dedup(rows, id_col, text_col, extra={"__row": F.col("__row")}, bits=bits)
                .where("group_size > 1").select("__row", "doc_id", "kept", "full_hash"), "copies")
    # rows that repeat the id that stays: the first of them does
    first = found.where("kept AND doc_id IS NOT NULL").groupBy("full_hash").agg(F.min("__row").alias("__row"))
    gone = cut(found.where("NOT kept OR doc_id IS NOT NULL").join(first, "__row", "left_anti").select("__row"), "gone")
    return without(rows, gone, bits).select(*docs.columns).withColumnsRenamed(back)
