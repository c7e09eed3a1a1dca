"""WARC archives: written as records with revisits, read back by verifying the chain of record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.exact_dedup import may_repeat
from tidemark.session import cut, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_REVISIT_BYTES = 100
FILE_RECORDS = 20_000
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, bytes, digest, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the row with the smallest id is the response, the others revisit it;
    smaller payloads are responses. Null payloads are empty; a null id revisits, if another row has the payload. Digests are
    counted with partial sums; a bitmap of fixed size tells the scan which may repeat, so a payload that occurs once is
    not shuffled, and the others meet a table of repeated digests.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    large = rows.where(F.col("bytes") >= least)
    again = F.col("__again") & (F.col("bytes") >= least)
    flagged = may_repeat(rows, ["digest"], large, "__again")
    first = large.groupBy("digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    alone = flagged.where(~again).withColumn("__first", F.lit(None).cast("long"))
    several = flagged.where(again).join(first, "digest", "left").withColumn(
        "__first", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")))
    return alone.unionByName(several).select("page_id", "url", "payload", "bytes", "digest",
                                             F.when(F.col("__first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("__first").alias("refers_to"))


def _header_text(url: Column) -> Column:
    """Line ends and other controls of a URL in percent form."""
    out = F.regexp_replace(url, "\r", "%0D")
    return F.regexp_replace(F.regexp_replace(out, "\n", "%0A"), r"[\x00-\x1F\x7F]", "%20")


def record(rows: DataFrame) -> Column:
    """The text of a record without its closing line ends. A revisit carries the digest and length of the payload it leaves out."""
    body = F.concat(F.lit(HTTP + END), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.concat(F.lit(MAGIC + "WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _header_text(F.col("url"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def write(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Archives of at most ``file_records`` records, by Spark's text writer: a record's two closing line ends part the rows."""
    records.select(record(records).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)", 1)


def _parsed(text: str) -> dict[str, Column]:
    """What stands in a chunk that follows the magic: the header, and the payload if it is all there."""
    chunk = F.concat(F.lit("\r\n"), F.col(text))
    header = F.substring_index(chunk, END, 1)
    head_bytes = F.octet_length(header) - 2
    http_bytes = F.octet_length(F.substring_index(F.col(text), END, 2)) - head_bytes
    length = F.try_to_number(_field(header, "Content-Length"), F.lit("999999999999999")).cast("long")
    payload = F.substring(F.col(text).cast("binary"), (head_bytes + http_bytes + len(END) + 1).cast("int"), (length - http_bytes).cast("int"))
    return {
        "head": head_bytes, "length": length, "type": _field(header, "WARC-Type"),
        "page_id": F.regexp_extract(header, r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>", 1),
        "refers": F.regexp_extract(header, r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>", 1),
        "said_digest": F.regexp_extract(header, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})", 1),
        "said_bytes": _field(header, "WARC-Payload-Length"),
        "bytes": F.octet_length(payload).cast("long"), "digest": F.sha2(payload, 256),
    }


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, by Spark's text reader, which splits large files: file, block, row, value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def _placed(chunks: DataFrame) -> DataFrame:
    """Adds ``at``, the byte where a chunk's magic stands (the first chunk of a file stands before the first magic).

    The chunks and magics before a chunk add up to its place: within a split in the order of reading, then over the splits
    of a file.
    """
    step = F.col("size") + len(MAGIC)
    blocks = chunks.groupBy("file", "block").agg(F.sum(step).alias("__all"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("__all").over(ahead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.join(offsets, ["file", "block"]).withColumn(
        "at", F.col("__base") + F.coalesce(F.sum(step).over(inside), F.lit(0)) - len(MAGIC)).drop("__base", "block", "row")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place where the magic stands: file, at (byte), next (where its record would end), whether the chunk up to the
    next magic is that record (``whole``), and the header's fields."""
    size = F.octet_length("value").cast("long")
    slim = cut(_chunks(spark, path).select("file", "block", "row", size.alias("size"), *[c.alias(k) for k, c in _parsed("value").items()]), "chunks")
    end = F.col("head") + F.col("length") + 2 * len(END)
    return _placed(slim).withColumns({"next": F.col("at") + len(MAGIC) + end, "whole": F.coalesce(end == F.col("size"), F.lit(False))})


def reachable(found: DataFrame) -> DataFrame:
    """Adds ``own``: whether a chunk starts a record, which it does if the chain of record ends from the file's start leads to it.

    Candidates whose record ends where the next candidate stands form a run. Only run ends have to be followed: each run knows
    the run - and the place in it - where its last record ends, and pointer jumping doubles these links until
    every run that the file's first one reaches is marked, with the place where it is entered.
    """
    order = Window.partitionBy("file").orderBy("at")
    breaks = found.withColumn("__break", F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True)))
    runs = cut(breaks.withColumn("run", F.sum(F.col("__break").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__break"), "runs")
    ends = runs.groupBy("file", "run").agg(F.min("at").alias("start"), F.max_by("next", "at").alias("to"))
    places = runs.select("file", F.col("at").alias("to"), F.col("run").alias("into"))
    steps = cut(ends.join(places, ["file", "to"], "left").select(
        "file", "run", "into", F.when(F.col("into").isNotNull(), F.col("to")).alias("entry"),
        F.when(F.col("start") == 0, F.lit(0).cast("long")).alias("mark")), "steps")
    marked = steps.where("mark IS NOT NULL").count()
    # steps: a run, the run that 2**k jumps lead to and where it is entered, and where this one is entered itself (if it is reached)
    while True:
        hits = steps.where("mark IS NOT NULL AND into IS NOT NULL").select("file", F.col("into").alias("run"), F.col("entry").alias("__hit")).groupBy(
            "file", "run").agg(F.min("__hit").alias("__hit"))
        jump = steps.select("file", F.col("run").alias("into"), F.col("into").alias("__into"), F.col("entry").alias("__entry"))
        steps = cut(steps.join(hits, ["file", "run"], "left").withColumn("mark", F.coalesce("mark", "__hit")).join(jump, ["file", "into"], "left").select(
            "file", "run", F.col("__into").alias("into"), F.col("__entry").alias("entry"), "mark"), "steps")
        now = steps.where("mark IS NOT NULL").count()
        if now == marked and steps.where("mark IS NOT NULL AND into IS NOT NULL").isEmpty():
            break
        marked = now
    reached = steps.where("mark IS NOT NULL").select("file", "run", "mark")
    return runs.join(reached, ["file", "run"], "left").withColumn("own", F.coalesce(F.col("at") >= F.col("mark"), F.lit(False)) & F.col("next").isNotNull()).drop("mark", "run")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and ``intact``.

    Of a response, length and digest are those of the payload read, and ``intact`` tells whether the header says the same; a
    revisit has them from its header. Where the magic stands in a payload, the record is put together from its chunks: the texts
    of such files are read again, and only there.
    """
    fields = ["page_id", "type", "refers", "said_digest", "said_bytes", "bytes", "digest"]
    chunks = cut(reachable(candidates(spark, path)).where("at >= 0"), "records")
    every = chunks.where("own AND whole").select(*fields)
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = chunks.select("file", "at", F.max(F.when(F.col("own"), F.col("at"))).over(order).alias("record"), "own", "whole")
    needed = owned.where("record IS NOT NULL AND NOT (own AND whole)").select("file", "at", "record")
    if not needed.isEmpty():
        texts = _placed(_chunks(spark, path).join(needed.select("file").distinct(), "file", "left_semi").withColumn("size", F.octet_length("value").cast("long")))
        built = texts.join(needed, ["file", "at"]).groupBy("file", "record").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        every = every.unionByName(built.select(*[c.alias(k) for k, c in _parsed("value").items() if k in fields]))
    response = F.col("type") == "response"
    return every.select(
        F.when(F.col("page_id") != "", F.col("page_id").cast("long")).alias("page_id"),
        F.when(response, F.col("bytes")).otherwise(F.col("said_bytes").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("said_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"),
        (~response | ((F.col("digest") == F.col("said_digest")) & (F.col("bytes").cast("string") == F.col("said_bytes")))).alias("intact"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write(plan_records(pages, id_col, url_col, payload_col), path)
    return read(pages.sparkSession, path)
