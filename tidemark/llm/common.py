"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.session import cut

#: Bits of the filter that carries keys to a scan: 2**23 bits are at most 256 rows of 4 KB, 1 MB whatever the size of
#: the table. Keys that share a bit cost needless work on a row, never a result.
FILTER_BITS = 23

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send this module's functions and classes to the tasks by value, so that nothing has to be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker and is shared by the tasks that run in it."""
    module = sys.modules.setdefault("tidemark_worker_store", types.ModuleType("tidemark_worker_store"))
    return module.__dict__.setdefault(name, {})


def only_store(name: str) -> dict:
    """The worker's dict of that name; those that other operators left in this worker go."""
    stores = sys.modules.setdefault("tidemark_worker_store", types.ModuleType("tidemark_worker_store")).__dict__
    for other in [k for k in stores if not k.startswith("__") and k != name]:
        del stores[other]
    return stores.setdefault(name, {})


def release() -> None:
    """Give freed memory back at a task's end: a worker that waits for its next task would keep it beside the executor's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def set_aside(df: DataFrame, *but: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns that begin with two underscores, as the operators' own do, under other names, and the names to
    give back."""
    taken, names = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("__") and c not in but:
            new = f"aside{c}"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            names[c] = new
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only. A text of one byte per character is ASCII, where ``lower`` does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def crc_mod(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % n


def _slot(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1


def key_bits(rows: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The bitmap of the rows' ``keys``, in rows of 4 KB."""
    return rows.select(_slot(keys, bits).alias("__s")).groupBy(F.bitmap_bucket_number("__s").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__s")).alias("__bits"))


def flagged(rows: DataFrame, keys: list[str], filled: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds a boolean: false only where the row's ``keys`` aren't in the bitmap ``filled``."""
    position = F.bitmap_bit_position(_slot(keys, bits))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(position, F.lit(8)).cast("int"))
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(_slot(keys, bits)))
            .join(F.broadcast(filled), "__bucket", "left")
            .withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("__bucket", "__bits"))


def may_repeat(rows: DataFrame, keys: list[str], counted: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds a boolean: false only where no other row has the same ``keys``. ``counted`` has the rows whose keys count."""
    repeated = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return flagged(rows, keys, key_bits(repeated, keys, bits), flag, bits)


def keyed(df: DataFrame, id_col: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows with a key of their own, the text ``__row``. A row whose id no other row has is named by the id and stays where it
    is; only rows without an id, or that may share theirs, are numbered and written, so that their number stays the same."""
    ids = df.select(F.col(id_col).alias("__id"))
    repeated = ids.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    marked = flagged(df.withColumn("__id", F.col(id_col)), ["__id"], cut(key_bits(repeated, ["__id"], bits), "bits"), "__odd", bits)
    odd = F.col("__odd") | F.col("__id").isNull()
    number = F.concat(F.lit("n"), F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"))
    numbered = cut(marked.where(odd).drop("__id", "__odd").withColumn("__row", number), "rows")
    return marked.where(~odd).withColumn("__row", F.concat(F.lit("i"), F.col("__id").cast("string"))).drop("__id", "__odd").unionByName(numbered)


def without(rows: DataFrame, gone: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``__row`` isn't in ``gone``. A bitmap lets most of those that stay pass where they are read; the others are joined."""
    marked = flagged(rows, ["__row"], cut(key_bits(gone, ["__row"], bits), "bits"), "__hit", bits)
    stay = marked.where("__hit").drop("__hit").join(gone, "__row", "left_anti")
    return marked.where("NOT __hit").drop("__hit").unionByName(stay)


def among(rows: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``__row`` is in ``wanted``, with its columns (one row per ``__row``); a bitmap drops most others before the join."""
    marked = flagged(rows, ["__row"], cut(key_bits(wanted, ["__row"], bits), "bits"), "__hit", bits)
    return marked.where("__hit").drop("__hit").join(wanted, "__row")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, per name in ``sums``, the total of that value over all rows up to and with this one in ``order``.

    Rows are dealt out by range and written once; each range sums for itself, and the ranges' own
    totals - a row per partition - give what lies before a range. Equal order keys share a range, so
    ``order`` should be unique for a defined result among ties.
    """
    named = {f"__o{i}": c for i, c in enumerate(order)}
    parts = cut(df.withColumns({**named, **{f"__v_{k}": v for k, v in sums.items()}})
                .repartitionByRange(*named).withColumn("__p", F.spark_partition_id()), "ranges")
    ranges = parts.groupBy("__p").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    within = Window.partitionBy("__p").orderBy(*named).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(offsets, "__p").withColumns(
        {k: F.col(f"__b_{k}") + F.sum(f"__v_{k}").over(within) for k in sums}).select(*df.columns, *sums)


ship(__name__)
