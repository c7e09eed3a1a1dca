"""Mixing sources to target weights, to the word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, keyed, running_totals, set_aside
from tidemark.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKET_ROWS = 2_000
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source (``__src`` as ``__key``): docs, size and target words.

    The n-th source by code point (null last) has weight ``weights[n mod len]``. The budget, ``share`` of all
    words, goes out by weight; no target exceeds ``most`` times its source, and what is over is shared anew. In
    the order of size per weight, the sources that fill up come first, so running sums find them.
    """
    sources = sized.groupBy("__key", "__src").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    ranked = running_totals(sources, [F.col("__src").isNull(), F.col("__src")], {"__rank": F.lit(1)})
    weighed = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                    (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    filled = cut(running_totals(weighed, [F.col("source_size") / F.col("__w"), F.col("__rank")],
                                {"__size_to": F.col("source_size"), "__w_to": F.col("__w")}), "sources")
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("__w").alias("w")).first()
    size, weight = total.size or 0, total.w or 0
    before_size, before_w = F.col("__size_to") - F.col("source_size"), F.col("__w_to") - F.col("__w")
    full = most * F.col("source_size") * (weight - before_w) <= F.col("__w") * (share * size - most * before_size)
    marked = filled.withColumn("__full", full)
    left = marked.where("NOT __full").agg(F.sum("source_size").alias("size"), F.sum("__w").alias("w")).first()
    rest, rest_w = share * size - most * (size - (left.size or 0)), float(left.w or 1)
    target = F.when(F.col("__full"), (most * F.col("source_size")).cast("double")).otherwise(
        F.lit(float(rest)) * F.col("__w") / F.lit(rest_w))
    return marked.select("__key", "docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        bucket_rows: int = BUCKET_ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and copies.

    ``taken`` counts the words that the mix takes of a document. A source gives as many whole epochs as fit in its
    target; the last epoch is cut in the order of the documents' hash keys: running sums of their sizes tell how
    much fits, and the document on the edge gives only its first words. So a source's taken words are its rounded
    target, and no document gives more than ``most`` times its size. ``copies`` are the whole times it is taken.

    A hash range of a source, of about ``bucket_rows`` rows, is summed by itself, and the ranges' totals give what
    lies before, so a source of any size is spread over tasks. Keys come from the ids, so reruns agree. Null texts
    and texts without words have size 0 and give nothing; a null source is a source. Rows with one id and one size
    are cut in some order, or in that of ``row_col``, a unique key: it is given out too and stands in for a null id's hash.
    An empty table gives an empty result.
    """
    row = [row_col] if row_col else []
    sized = cut(docs.select(
        *row,
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("__src"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("__key"), words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(*[F.col(c).cast("string") for c in [id_col, *row]], F.lit(""))).cast("binary")).alias("__hash")), "sized")
    sources = source_targets(sized, weights, share, most).withColumn(
        "__ranges", F.ceil(F.col("docs") / bucket_rows).cast("long"))
    keyed = sized.select(*row, "doc_id", "__key", "size", "__hash").join(sources, "__key").withColumn(
        "__range", F.shiftright(F.conv(F.substring("__hash", 1, 7), 16, 10).cast("long") * F.col("__ranges"), 28))
    ranges = keyed.groupBy("__key", "__range").agg(F.sum("size").alias("__total"))
    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__key", "__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    here = Window.partitionBy("__key", "__range").orderBy("__hash", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    words_wanted = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0).cast("long"))
    before = F.col("__offset") + F.sum("size").over(here) - F.col("size")
    return (keyed.join(offsets, ["__key", "__range"])
            .withColumns({"__epochs": epochs, "__before": before})
            .withColumn("__part", F.greatest(F.lit(0).cast("long"), F.least(
                F.col("size"), words_wanted - F.col("__epochs") * F.col("source_size") - F.col("__before"))))
            .select(*row, "doc_id", "size", "source_size", "target",
                    (F.col("__epochs") * F.col("size") + F.col("__part")).alias("taken"),
                    F.when(F.col("size") > 0, F.col("__epochs")).otherwise(F.lit(0).cast("long")).alias("copies"),
                    F.col("__part").alias("part")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: a row per whole copy taken, and one with the first words where a document is cut.

    Columns are those of ``docs``; ``n_chars``, where there is one, follows the text. Each row has a key of
    its own, so rows that share an id and rows without one are planned and taken like any other.
    """
    docs, back = set_aside(docs, id_col, text_col, source_col)
    rows = keyed(docs, id_col)
    plan = mix(rows, id_col, text_col, source_col, weights, share, most, row_col="__row").where("taken > 0").select(
        "__row", (F.col("copies") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)).alias("__whole"),
        F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(F.lit(0)).alias("__part"))
    rows = rows.join(plan, "__row").withColumn(
        "__take", F.explode(F.concat(
            F.array_repeat(F.lit(-1).cast("long"), F.col("__whole").cast("int")),
            F.when(F.col("__part") > 0, F.array(F.col("__part"))).otherwise(F.array().cast("array<bigint>")))))
    # the first n words with what stands between them
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)),
                                    F.lit(1), F.greatest(F.col("__take"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("__take") > 0, cut_text).otherwise(F.col(text_col))
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__take") > 0, F.char_length(cut_text).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns(new).select(*docs.columns).withColumnsRenamed(back)
