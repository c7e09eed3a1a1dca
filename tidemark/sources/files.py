"""Reading tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import predicates as P
from tidemark.operators.quality import quality

EXTENSIONS = ("csv", "json", "parquet")
BOOLEANS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Increasing, not contiguous ids in the order in which the partitions are read, which need not be that of the files
    (``scan_csv`` has numbers in file order); the same files and splits give the same ids."""
    return df.select(F.monotonically_increasing_id().alias(name), "*")


def infer_types(df: DataFrame) -> T.StructType:
    """Narrowest of LONG, DOUBLE, BOOLEAN, STRING that holds every filled cell; one aggregate over all rows."""
    whole = r"^\s*[+-]?[0-9]{1,18}\s*$"
    names = df.columns
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(whole)).alias(f"i{i}"),
                 F.count_if(P.numeric_text(c)).alias(f"d{i}"), F.count_if(c.isin(BOOLEANS)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    fields = []
    for i, n in enumerate(names):
        filled = r[f"n{i}"]
        t: T.DataType = T.StringType()
        if filled and r[f"i{i}"] == filled:
            t = T.LongType()
        elif filled and r[f"d{i}"] == filled:
            t = T.DoubleType()
        elif filled and r[f"b{i}"] == filled:
            t = T.BooleanType()
        fields.append(T.StructField(n, t))
    return T.StructType(fields)


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
             na_values: Sequence[str] = tuple(vocab.NA_TOKENS), row_id: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Missing-value tokens become NULL before the columns are typed; a cell that does
    not fit the given type becomes NULL, never an error.

    Large files are read in splits. ``multi_line`` allows line ends inside cells; a file is then one task. ``row_id`` numbers
    the rows 0.. in the order of file names and of the rows in a file, however the files are split.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
             F.monotonically_increasing_id().alias("__at")] if row_id else []
    raw = raw.select(*[
        F.when(F.col(f"`{c}`").isin(list(na_values)), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns], *place)
    if schema is None:
        schema = infer_types(raw.drop("__file", "__block", "__at"))
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    typed = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = P.parse_number(c).cast(f.dataType)
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.IntegralType):
            c = F.btrim(c).try_cast(f.dataType.simpleString())
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType.simpleString())
        typed.append(c.alias(f.name))
    return _numbered(raw, typed) if row_id else raw.select(*typed)


def _numbered(raw: DataFrame, columns: list, name: str = "row_id") -> DataFrame:
    """Rows numbered in file order. Spark packs splits by size, so a split's first number comes from the counts of the
    splits before it: a small table, a row per split. The rows themselves are not moved."""
    splits = raw.groupBy("__file", "__block").agg(F.min("__at").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__block", "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return raw.join(offsets, ["__file", "__block"]).select((F.col("__before") + F.col("__at") - F.col("__least")).alias(name), *columns)


def scan_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def scan_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """By extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return scan_csv(spark, path)
    if kind == "json":
        return scan_json(spark, path)
    if kind == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported dataset format: {kind}")


def dataset_files(spark: SparkSession, paths: Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """One row per dataset - a file or a folder of files: file, size, modified, accepted, reason. Metadata only.

    ``max_bytes`` is an upload rule of the caller's; without it any size is accepted.
    """
    out = None
    for p in paths:
        kind = p.rstrip("/").rsplit(".", 1)[-1].lower()
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(
            F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.max("modificationTime").alias("modified"))
        reason = F.when(F.lit(kind not in EXTENSIONS), F.lit("unknown extension"))
        if max_bytes is not None:
            reason = reason.when(F.col("size") > max_bytes, F.lit("too large"))
        one = sizes.select(F.lit(p).alias("file"), "size", "modified", reason.isNull().alias("accepted"), reason.alias("reason"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no dataset given")
    return out


def dataset_catalog(spark: SparkSession, paths: Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """One row per dataset: file, columns, rows, missing_pct, duplicates, quality_score, size, accepted, reason.

    Datasets that are not accepted keep their row, without the figures; their content is not read. The list of
    datasets is the caller's; a folder of part files is one dataset.
    """
    files = dataset_files(spark, paths, max_bytes)
    taken = {r.file for r in files.where("accepted").select("file").collect()} if max_bytes is not None else {
        p for p in paths if p.rstrip("/").rsplit(".", 1)[-1].lower() in EXTENSIONS}
    out = None
    for p in paths:
        if p not in taken:
            continue
        df = scan(spark, p)
        one = quality(df, skip=()).select(
            F.lit(p).alias("file"), F.lit(",".join(df.columns)).alias("columns"), "rows", "missing_pct", "duplicates",
            "quality_score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "file string, columns string, rows long, missing_pct double, duplicates long, quality_score double")
    return out.join(files.select("file", "size", "accepted", "reason"), "file", "right")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
