"""Token ids on disk: patched frame-of-reference blocks.

A store is a Parquet folder whose rows are segments: some whole documents of one range of ids, their counts, and
``data``: header, starts of the blocks, blocks. A block of up to ``BLOCK`` ids holds its minimum, the width at which
``PERCENTILE`` of the differences fit, the packed differences, and the ids that need more as a list of exceptions
(place and value). A segment is decoded alone, and a block alone within it. Spark's committer writes the rows, so any
file system will do and a lost executor costs a task.

Layout of ``data`` (little-endian): ``PFR1``, ids u32, block size u32, blocks u32, start of each block u32 (from the end of
this table); block: minimum u32, width u8, exceptions u16, packed differences (lowest bit first), places u16, values u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import ship
from tidemark.llm.tokens import encoder
from tidemark.session import scratch_path

MAGIC = b"PFR1"
BLOCK = 512
PERCENTILE = 90
#: A segment is closed once it has so many ids; a document is never split.
SEGMENT_IDS = 1 << 16

SEGMENTS = "shard int, segment int, first long, ids long, docs array<bigint>, counts array<int>, data binary"
READ = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The ``data`` of some ids (uint32)."""
    n = len(ids)
    blocks = -(-n // block)
    starts, out, at = [], [], 0
    for b in range(blocks):
        part = ids[b * block:(b + 1) * block]
        low = int(part.min())
        diff = part - np.uint32(low)
        rank = min(len(diff) - 1, int(len(diff) * percentile / 100))
        width = int(np.partition(diff, rank)[rank]).bit_length()
        places = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        bits = np.unpackbits(diff.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
        data = struct.pack("<IBH", low, width, len(places)) + packed + places.astype("<u2").tobytes() + part[places].astype("<u4").tobytes()
        starts.append(at)
        out.append(data)
        at += len(data)
    return b"".join([MAGIC, struct.pack("<III", n, block, blocks), np.array(starts, "<u4").tobytes(), *out])


def decode_block(data: bytes, b: int) -> np.ndarray:
    """The ids of one block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, block, blocks = struct.unpack_from("<III", data, 4)
    at = 16 + 4 * blocks + struct.unpack_from("<I", data, 16 + 4 * b)[0]
    count = min(block, n - b * block)
    low, width, more = struct.unpack_from("<IBH", data, at)
    at += 7
    size = -(-count * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:count * width].reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    ids = np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1) + np.uint32(low)
    at += size
    if more:
        ids[np.frombuffer(data, "<u2", more, at)] = np.frombuffer(data, "<u4", more, at + 2 * more)
    return ids


def decode_ids(data: bytes) -> np.ndarray:
    blocks = struct.unpack_from("<I", data, 12)[0]
    return np.concatenate([decode_block(data, b) for b in range(blocks)]) if blocks else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 shards: int | None = None) -> None:
    """Write all documents' ids in ascending order of their id, an ``end_id`` after each.

    Documents are dealt out by ranges of ids; a range is a shard, sorted, and each task keeps one segment in
    memory. Null texts count as empty, null ids come first, rows with one id follow each other in some order.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        from pyspark import TaskContext

        shard, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        first, segment, ids, names, counts, held = 0, 0, [], [], [], 0

        def row():
            data = encode_ids(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                pa.array([data], pa.binary())], names=["shard", "segment", "first", "ids", "docs", "counts", "data"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                got = enc.encode(text.as_py()) + end
                ids.append(got)
                names.append(name.as_py())
                counts.append(len(got) // 4)
                held += len(got) // 4
                if held >= SEGMENT_IDS:
                    yield row()
                    first, segment, ids, names, counts, held = first + held, segment + 1, [], [], [], 0
        if names:
            yield row()

    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
     .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(encode, SEGMENTS).write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the stored bytes.

    Segments are decoded where they are read, without a shuffle; a row per shard gives what lies before a shard.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, names, counts, data = (batch.column(c)[i].as_py() for c in (0, 1, 2, 3, 4))
                raw = decode_ids(data).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int32()), pa.array(first + starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64())],
                    names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    rows = segments.select("shard", "first", "docs", "counts", "data").mapInArrow(decode, READ)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.groupBy("shard").agg(F.sum("ids").alias("__ids")).select(
        "shard", F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__before"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("__before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)


ship(__name__)
