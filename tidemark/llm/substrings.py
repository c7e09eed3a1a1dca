"""Passages that documents share, by level-wise doubling: only windows that repeat at one length are extended to twice that length.

The first level looks at windows of half the length. Every window of the second level holds one of them that its hash makes the
smallest, so only these - a quarter of all - are counted, and a window whose smallest is met in one text alone can't repeat. The
levels after that extend a window only if both its ends repeated a level before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import ship, worker_store
from tidemark.session import cut

WORDS = 13
#: Words that a task compares among themselves before rows leave it: a window then leaves each such block once at most.
BLOCK_WORDS = 1_000_000
#: Hashes of words that a worker remembers.
KEEP = 400_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5)


def levels(words: int) -> list[int]:
    """Lengths to go through: half of ``words``, rounded up until it is at most 12, then its doubles up to ``words``."""
    out = [words]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out if len(out) > 1 else [(words + 1) // 2, words]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word; words stand between space, tab, line feed, vertical tab, form feed and carriage return."""
    import xxhash

    known, digest, out = worker_store("words"), xxhash.xxh64_intdigest, []
    for w in text.encode("utf-8", "surrogatepass").split():
        h = known.get(w)
        if h is None:
            h = digest(w, 7)
            if len(known) < KEEP and len(w) <= 32:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store("powers")
    have = store.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(n, 4096) * 2, _BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            with np.errstate(over="ignore"):
                p[1:] = b
                np.multiply.accumulate(p, out=p)
            both.append(p)
        have = store[which] = tuple(both)
    return have


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``length`` words; ``which`` picks one of two independent ones."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes) + 1, which)
    with np.errstate(over="ignore"):
        v = (hashes ^ (hashes >> np.uint64(31))) * _MIX[which]
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(v * up[:len(v)], out=total[1:])
        h = (total[length:] - total[:n]) * down[:n]
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def smallest_inside(hashes: np.ndarray, base: int, length: int) -> np.ndarray:
    """For every window of ``length`` words the smallest hash of the ``base``-word windows inside it."""
    h = window_hashes(hashes, base)
    n = len(hashes) - length + 1
    if n <= 0:
        return h[:0]
    low = h[:n].copy()
    for i in range(1, length - base + 1):
        np.minimum(low, h[i:n + i], out=low)
    return low


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first counts most), and the group number of each place in that order by all keys but the last."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    """Lists that begin at ``starts`` of the values."""
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _anchors(texts: DataFrame, base: int, length: int) -> DataFrame:
    """(hash, c1, known) of ``texts`` (c1, text).

    A hash that one text of a block alone has is a row (hash, c1). What several texts of the block have is known to repeat: one
    row (hash, null) witnesses it, and each of the texts has a row with a list of them. So a hash leaves a block once.
    """
    def block(ids, found):
        c1 = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
        hashes = np.concatenate(found)
        order, group = _sorted_groups(hashes, c1)
        hashes, c1 = hashes[order], c1[order]
        fresh = np.ones(len(order), bool)  # one of each text and hash
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (c1[1:] != c1[:-1])
        hashes, c1, group = hashes[fresh], c1[fresh], group[fresh]
        several = (np.bincount(group, minlength=1) > 1)[group]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        single, witness = ~several, several & first
        known_c, known_h = c1[several], hashes[several]
        by = np.argsort(known_c, kind="stable")
        known_c, known_h = known_c[by], known_h[by]
        starts = np.flatnonzero(np.append(True, known_c[1:] != known_c[:-1])) if len(known_c) else np.empty(0, np.int64)
        n_single, n_witness, n_known = int(single.sum()), int(witness.sum()), len(starts)
        out_hash = np.concatenate([hashes[single].view(np.int64), hashes[witness].view(np.int64), known_c[starts]])
        out_c = pa.array(np.concatenate([c1[single], np.zeros(n_witness, np.int64), known_c[starts]]), pa.int64(),
                         mask=np.concatenate([np.zeros(n_single, bool), np.ones(n_witness, bool), np.zeros(n_known, bool)]))
        known = pa.concat_arrays([pa.nulls(n_single + n_witness, pa.list_(pa.int64())), _lists(known_h.view(np.int64), starts, pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(out_hash, pa.int64()), out_c, known], names=["hash", "c1", "known"])

    def run(batches):
        ids, found, held = [], [], 0
        for batch in batches:
            for c1, text in zip(batch.column(0), batch.column(1)):
                words = word_hashes(text.as_py())
                low = smallest_inside(words, base, length)
                if not len(low):
                    continue
                ids.append(c1.as_py())
                found.append(np.unique(low[np.append(True, low[1:] != low[:-1])]))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield block(ids, found)
                    ids, found, held = [], [], 0
        if ids:
            yield block(ids, found)

    return texts.mapInArrow(run, "hash long, c1 long, known array<long>")


def _repeated_anchors(texts: DataFrame, base: int, length: int) -> DataFrame:
    """(c1, hashes): per text the smallest hashes that another text has too. A group holds a row per block at most."""
    w = Window.partitionBy("hash")
    marked = _anchors(texts, base, length).withColumns({
        "__lo": F.min("c1").over(w), "__hi": F.max("c1").over(w), "__witness": F.max(F.col("c1").isNull()).over(w)})
    kept = marked.where("c1 IS NOT NULL AND (known IS NOT NULL OR __lo != __hi OR __witness)")
    own = F.when(F.col("known").isNull(), F.array("hash")).otherwise(F.col("known"))
    return kept.select("c1", own.alias("own")).groupBy("c1").agg(F.flatten(F.collect_list("own")).alias("marks"))


def _windows(wanted: DataFrame, length: int, before: int, first: bool) -> DataFrame:
    """(h1, h2, k, doc, at, dup, known): the windows of ``wanted`` (k, doc, text, marks) that may repeat.

    ``marks`` are smallest hashes of half length (``first``) or the places of windows of ``before`` words that repeat. Of a
    block's equal windows those of the smallest doc leave as one row (``at``: their places); ``dup`` says that others have
    them too. The others' places are known to be later ones: a row per document.
    """
    def block(rows):
        size = [len(r[2]) for r in rows]
        which = np.repeat(np.arange(len(rows)), size)
        h1, h2, at = (np.concatenate([r[i] for r in rows]) for i in (2, 3, 4))
        docs, ks = np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64)
        order = np.lexsort((at, which, docs[which], h2, h1))
        h1, h2, at, which = h1[order], h2[order], at[order], which[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        mine = which == which[starts][group]
        low = docs[which] == docs[which[starts]][group]  # another text of the same id is not a later one
        dup = np.bincount(group, ~mine, len(starts)) > 0
        extra = low & ~mine
        per_group = np.bincount(group, mine, len(starts)).astype(np.int64)
        offsets = np.append(0, np.cumsum(per_group))[:-1]
        later = ~low
        lw, la = which[later], at[later]
        by = np.lexsort((la, lw))
        lw, la = lw[by], la[by]
        l_starts = np.flatnonzero(np.append(True, lw[1:] != lw[:-1])) if len(lw) else np.empty(0, np.int64)
        e = np.flatnonzero(extra)
        owner = which[starts]
        lists = pa.concat_arrays([_lists(at[mine], offsets, pa.int32()), _lists(at[e], np.arange(len(e)), pa.int32()),
                                  _lists(la, l_starts, pa.int32())])
        l_owner = lw[l_starts] if len(lw) else lw
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([h1[starts].view(np.int64), h1[e].view(np.int64), ks[l_owner]]), pa.int64()),
            pa.array(np.concatenate([h2[starts].view(np.int64), h2[e].view(np.int64), docs[l_owner]]), pa.int64()),
            pa.array(np.concatenate([ks[owner], ks[which[e]], ks[l_owner]]), pa.int64()),
            pa.array(np.concatenate([docs[owner], docs[which[e]], docs[l_owner]]), pa.int64()),
            lists,
            pa.array(np.concatenate([dup, np.ones(len(e), bool), np.ones(len(l_owner), bool)]), pa.bool_()),
            pa.array(np.concatenate([np.zeros(len(starts) + len(e), bool), np.ones(len(l_owner), bool)]), pa.bool_()),
        ], names=["h1", "h2", "k", "doc", "at", "dup", "known"])

    def run(batches):
        rows, held, seen = [], 0, set()
        for batch in batches:
            for k, doc, text, marks in zip(*(batch.column(i) for i in range(4))):
                if (k.as_py(), doc.as_py()) in seen:  # a repeated row
                    continue
                seen.add((k.as_py(), doc.as_py()))
                words = word_hashes(unpacked(text.as_py()))
                n = len(words) - length + 1
                if n <= 0:
                    continue
                marks = marks.values.to_numpy()
                if first:
                    at = np.flatnonzero(np.isin(smallest_inside(words, before, length), marks.view(np.uint64)))
                else:
                    here = np.zeros(n + length, bool)
                    here[marks] = True
                    at = np.flatnonzero(here[:n] & here[length - before:length - before + n])
                if not len(at):
                    continue
                rows.append((k.as_py(), doc.as_py(), window_hashes(words, length)[at], window_hashes(words, length, 1)[at], at.astype(np.int32)))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield block(rows)
                    rows, held = [], 0
        if rows:
            yield block(rows)

    return wanted.select("k", "doc", "text", "marks").mapInArrow(
        run, "h1 long, h2 long, k long, doc long, at array<int>, dup boolean, known boolean")


def unpacked(packed: bytes) -> str:
    import zstandard

    return zstandard.decompress(packed).decode("utf-8", "surrogatepass")


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text (last column) compressed for the exchange."""
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            text = pa.array((pack(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, `{rows.columns[-1]}` binary")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, c1, c2, k, text): two hashes of the text, and one of text and id, which spreads equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2"), text.alias("text"))
    return rows.select("doc", "c1", "c2", F.xxhash64("c1", "doc").alias("k"), "text")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(k, doc, whole, at): what of each text also stands in a document with a smaller id.

    ``at`` are the places of windows of ``words`` words whose words also stand, in that order, in a document with a smaller
    id; ``whole`` marks a text that such a document has word for word, all windows of which are such. Texts without either
    have no row. ``k`` and ``doc`` name a row's text and id (see ``drop_repeated``).
    """
    rows = _marked(docs, id_col, text_col).where("doc IS NOT NULL")
    texts = cut(rows.select("doc", "c1", "c2", "k"), "texts")
    firsts = cut(texts.groupBy("c1", "c2").agg(F.min("doc").alias("doc")), "firsts")
    copies = texts.join(firsts.withColumnRenamed("doc", "first"), ["c1", "c2"]).where("doc > first").select("k", "doc").distinct()
    steps = levels(words)
    marks = _repeated_anchors(rows.select("c1", "text"), steps[0], steps[1])
    wanted = marks.join(firsts, "c1").select(F.xxhash64("c1", "doc").alias("k"), "doc", "marks")
    for i, length in enumerate(steps[1:]):
        need = cut(wanted, "wanted")
        mine = _packed(rows.select("k", "doc", "text"))
        here = _windows(mine.join(need, ["k", "doc"]), length, steps[i], i == 0)
        w = Window.partitionBy("h1", "h2")
        marked = here.withColumns({"__first": F.min("doc").over(w), "__dup": F.max("dup").over(w), "__n": F.count(F.lit(1)).over(w)})
        if length < words:
            wanted = marked.where("__dup OR __n > 1").groupBy("k", "doc").agg(F.flatten(F.collect_list("at")).alias("marks"))
    later = marked.where("known OR doc > __first").groupBy("k", "doc").agg(F.flatten(F.collect_list("at")).alias("at"))
    return later.select("k", "doc", F.lit(False).alias("whole"), "at").unionByName(
        copies.select("k", "doc", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("at")))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept - its words joined by one space, without those covered by a repeated window.

    A window is ``words`` words of one text; it is repeated if a row with a smaller id holds the same words in that order
    anywhere. Windows are judged on the input. Null texts have no words. A row with a null id loses nothing and takes nothing
    from others; rows of one id take nothing from each other, and equal ones get equal results. Texts below ``words`` words
    keep all. An empty table gives no rows; other columns are not looked at.
    """
    found = repeated(docs, id_col, text_col, words)
    rows = _packed(_marked(docs, id_col, text_col).select("k", "doc", "text"))
    one = found.groupBy("k", "doc").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("at")).alias("at"))
    joined = rows.join(one, ["k", "doc"], "left").select("doc", "text", F.coalesce("whole", F.lit(False)).alias("whole"),
                                                         F.coalesce("at", F.array().cast("array<int>")).alias("at"))

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, whole, at in zip(*(batch.column(i) for i in (1, 2, 3))):
                w = unpacked(text.as_py()).encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(w) + 1, np.int64)
                if whole.as_py():
                    gone[:max(0, len(w) - words + 1)] = 1
                elif len(at.values):
                    gone[at.values.to_numpy()] = 1
                total = np.cumsum(gone)
                covered = total[:-1].copy()
                covered[words:] -= total[:max(0, len(w) - words)]
                keep = covered == 0
                n_words.append(len(w))
                n_removed.append(len(w) - int(keep.sum()))
                kept.append(b" ".join(w if keep.all() else [x for x, y in zip(w, keep.tolist()) if y]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


ship(__name__)
