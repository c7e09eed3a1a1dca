"""Small tables and brute-force helpers for the tests of this folder."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def docs(spark, texts, parts=3, sources=None):
    return frame(spark, [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None)
                         for i, t in enumerate(texts)], parts=parts)


def crc(i):
    return zlib.crc32(str(i).encode())


def clashing(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(7) for n in ("score", "size", "key", "kept", "keep_id", "start", "fp", "node", "rank", "length",
                                                 "bytes", "digest", "record", "value", "v", "q", "found", "predicted", "__row", "__id", "__take",
                                                 "__whole", "__key", "__size", "__ROW_2")})
