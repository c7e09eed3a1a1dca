"""Language of a text by prediction by partial matching: the language whose byte model codes the text shortest wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import ship

#: Documents per language that the models are fitted on (those with the smallest hash of the id).
TRAIN_DOCS = 400
#: Languages at most; the sample is broadcast, so this and TRAIN_DOCS bound it.
MOST_LANGUAGES = 255
#: Bytes of context. Keys of ORDER + 1 bytes fit 32 bits.
ORDER = 3
START = b"\n" * ORDER
CHUNK = 1 << 20


class Lookup:
    """uint32 keys to their places, for whole arrays: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, self.probes = np.arange(len(keys), dtype=np.int32), 0
        home = self._home(self.keys)
        while len(left):
            at = (home[left] + np.uint32(self.probes)) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places; -1 where a key is not there."""
        home = self._home(keys)
        out = self.slots[home & self.mask]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for p in range(1, self.probes + 1):
            if not len(open_):
                break
            got = self.slots[(home[open_] + np.uint32(p)) & self.mask]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out


def _grams(text: str) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    b = np.frombuffer(START + text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


class Model:
    """Frozen context trees of all languages as tables of code lengths, in bits.

    A symbol seen in the longest context costs -log2 n / (total + distinct) there; else the escape, -log2 distinct / (total +
    distinct), is paid and the next shorter context asked, down to eight bits for any byte. A context that was never seen
    costs no escape. Tables hold the keys that some language has seen, with every language's cost.
    """

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: per language the keys (context and symbol, four bytes) and how often each was seen."""
        self.languages = languages
        n = len(languages)
        level: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in languages:
            keys, times = counts[lang]
            own = []
            for order in range(ORDER, -1, -1):
                k, where = np.unique(keys & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
                own.append((k, np.bincount(where, times, len(k))))
            level.append(own[::-1])
        tables, escapes = [np.full((1, n), 8.0)], []
        self.union: list[np.ndarray] = []
        for order in range(ORDER + 1):
            union = np.unique(np.concatenate([level[i][order][0] for i in range(n)]))
            contexts = np.unique(union >> np.uint64(8))
            cost, escape = np.zeros((len(union), n)), np.zeros((len(contexts), n))
            for i in range(n):
                k, t = level[i][order]
                c, where = np.unique(k >> np.uint64(8), return_inverse=True)
                total = np.bincount(where, t) + np.bincount(where)
                escape[np.searchsorted(contexts, c), i] = -np.log2(np.bincount(where) / total)
                lower = self._at(union, order - 1, tables, escapes, i)
                cost[:, i] = escape[np.searchsorted(contexts, union >> np.uint64(8)), i] + lower
                cost[np.searchsorted(union, k), i] = -np.log2(t / total[where])
            self.union.append(union)
            tables.append(cost)
            escapes.append((contexts, escape))
        self.tables, self.escapes = tables, escapes
        low = np.arange(65536, dtype=np.uint64)
        self.order1 = np.stack([self._at(low, 1, tables, escapes, i) for i in range(n)], 1).astype(np.float32)
        self.cost2, self.cost3 = tables[3].astype(np.float32), tables[4].astype(np.float32)
        self.escape2, self.escape3 = escapes[2][1].astype(np.float32), escapes[3][1].astype(np.float32)
        self.find2, self.find3 = Lookup(self.union[2]), Lookup(self.union[3])
        self.context2, self.context3 = Lookup(escapes[2][0]), Lookup(escapes[3][0])
        del self.tables, self.escapes

    def _at(self, keys, order, tables, escapes, i):
        """Code lengths of one language for any keys, from ``order`` down."""
        if order < 0:
            return np.full(len(keys), 8.0)
        k = keys & np.uint64((1 << (8 * (order + 1))) - 1)
        union = self.union[order]
        at = np.minimum(np.searchsorted(union, k), len(union) - 1)
        seen = union[at] == k
        out = np.empty(len(k))
        out[seen] = tables[order + 1][at[seen], i]
        rest = k[~seen]
        contexts, escape = escapes[order]
        c = np.minimum(np.searchsorted(contexts, rest >> np.uint64(8)), len(contexts) - 1)
        out[~seen] = np.where(contexts[c] == rest >> np.uint64(8), escape[c, i], 0.0) + self._at(rest, order - 1, tables, escapes, i)
        return out

    def bits(self, text: str) -> np.ndarray:
        """Code length of the text per language."""
        total = np.zeros(len(self.languages))
        grams = _grams(text)
        for start in range(0, len(grams), CHUNK):
            k = grams[start:start + CHUNK]
            at = self.find3(k)
            seen = at >= 0
            total += self.cost3[at[seen]].sum(0, dtype=np.float64)
            rest = k[~seen]
            if len(rest):
                total += self._escaped(self.context3, self.escape3, rest >> np.uint32(8))
                rest &= np.uint32(0xFFFFFF)
                at = self.find2(rest)
                seen = at >= 0
                total += self.cost2[at[seen]].sum(0, dtype=np.float64)
                rest = rest[~seen]
                if len(rest):
                    total += self._escaped(self.context2, self.escape2, rest >> np.uint32(8))
                    total += self.order1[rest & np.uint32(0xFFFF)].sum(0, dtype=np.float64)
        return total

    @staticmethod
    def _escaped(find: Lookup, escape: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        at = find(contexts)
        return escape[at[at >= 0]].sum(0, dtype=np.float64)

    def predict(self, text: str) -> tuple[str, float]:
        bits = self.bits(text)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS) -> Model | None:
    """Models of all languages named in the rows where ``learn`` holds; None where there is none."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if not seen:
        return None
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # the hash alone keeps about twice as many rows of a language as are wanted; only those are ranked
    space = 1 << 40
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(space))
    wanted = F.create_map(*[x for r in seen for x in (F.lit(r[0]), F.lit(space if r.n <= 2 * train_docs else 2 * train_docs * space // r.n))])
    first = Window.partitionBy("__lang").orderBy("__place", "__id")
    chosen = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), place.alias("__place")).where(
        F.col("__place") < wanted[F.col("__lang")]).withColumn("__n", F.row_number().over(first)).where(
        F.col("__n") <= train_docs).select("__id", "__lang")
    sample = rows.join(F.broadcast(chosen), (F.col(id_col) == F.col("__id")) & (F.col(lang_col) == F.col("__lang"))).select(
        F.col("__lang").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0), batch.column(1)):
                by.setdefault(lang.as_py(), []).append(_grams(text.as_py()))
            for lang, grams in by.items():
                k, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: (g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy().astype(float)) for lang, g in counted.groupby("lang")}
    return Model(sorted(counts), counts) if counts else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score, and the ``keep`` columns.

    The score is the language's share of the likelihood. Null texts and texts without a letter are ``und`` with score
    0; so is everything where no language was learned. Of languages with one code length the first by name wins. One
    scan, a text in memory at a time, no shuffle.
    """
    kept = keep or []
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    names = [*rows.columns[:-1], "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            got = [("und", 0.0) if model is None or t is None else model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    return rows.mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))


ship(__name__)
