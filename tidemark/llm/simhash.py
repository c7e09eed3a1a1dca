"""SimHash near-duplicates, linked through BK-trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ship
from tidemark.llm.components import components
from tidemark.session import cut

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints that one tree takes; a larger shard is dealt out further.
MOST_IN_TREE = 4_096


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64 bits: bit i is 1 if it is set in over half of the shingles' hashes; 0 if there is no word.

    A-Z count as a-z; words stand between space, tab, line feed, vertical tab, form feed and carriage return; shingles count
    as often as they occur; fewer words than a shingle are one shingle.
    """
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:len(w) - words + 1].tolist(), ends[words - 1:].tolist())),
                         np.uint64, len(w) - words + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)])
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long. Null texts have no word."""
    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows the edges within the radius only."""

    def __init__(self):
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        self.children.setdefault(x, {})
        if self.root is None:
            self.root = x
            return
        at = self.root
        while at != x:
            d = (at ^ x).bit_count()
            at_next = self.children[at].get(d)
            if at_next is None:
                self.children[at][d] = x
                return
            at = at_next

    def search(self, x: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(max(d - radius, 1), d + radius + 1) if k in children]
        return found


def _spanning(fps: list[int], nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius, at most one per fingerprint: (node, node)."""
    parent = list(range(len(fps)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, at = BKTree(), {}
    for i, x in enumerate(fps):
        for y in tree.search(x, radius):
            a, b = top(i), top(at[y])
            if a != b:
                parent[max(a, b, key=nodes.__getitem__)] = min(a, b, key=nodes.__getitem__)
        tree.add(x)
        at.setdefault(x, i)
    return [(nodes[i], nodes[top(i)]) for i in range(len(fps)) if top(i) != i]


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    """The bit places in n runs of nearly one length."""
    size, more = divmod(len(bits), n)
    out, at = [], 0
    for i in range(n):
        out.append(bits[at:at + size + (i < more)])
        at += size + (i < more)
    return out


def _mask(places: list[int]) -> int:
    m = sum(1 << p for p in places)
    return m - (1 << 64) if m >= 1 << 63 else m


def linked(fps: DataFrame, radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (``fp``, ``node``) that connect all within the radius.

    Of ``radius + 1`` runs of bits, two fingerprints within the radius share one, so a shard is a run and its
    value. A shard of more than ``most`` fingerprints is dealt out again by the same rule over the bits that its
    fingerprints don't share yet, at most twice: then at most 20 bits are open at radius 2, and distinct fingerprints bound the
    shard. Each shard has its BK-tree in the task that holds it, and gives a spanning forest, so links stay
    below the fingerprints times the runs however dense a shard is.
    """
    runs = radius + 1

    def expand(rows: DataFrame, above: Column, open_bits: list[int]) -> DataFrame:
        # a key is a hash of the runs shared so far: two shards that meet by chance only cost a comparison
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(above, F.lit(i), F.col("fp").bitwiseAND(F.lit(_mask(b)))).alias("key"))
                            for i, b in enumerate(_blocks(open_bits, runs))])
        return rows.select("fp", "node", F.explode(options).alias("__o")).select("fp", "node", "__o.key", "__o.i")

    found = None
    places = list(range(64))
    levels = [(expand(fps, F.lit(0).cast("long"), places), places)]
    for depth in range(3):
        following = []
        for rows, open_bits in levels:
            small = rows
            if depth < 2:
                full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("key")
                if not full.isEmpty():
                    large = cut(rows.join(full, "key"), "shards")
                    small = rows.join(full, "key", "left_anti")
                    for i, b in enumerate(_blocks(open_bits, runs)):
                        rest = [p for p in open_bits if p not in b]
                        following.append((expand(large.where(F.col("i") == i), F.col("key"), rest), rest))
            part = _tree_links(small.select("key", "fp", "node"), radius)
            found = part if found is None else found.unionByName(part)
        levels = following
    return found


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links of every shard, shard after shard in each task."""
    def run(batches):
        key, fps, nodes, out = None, [], [], []
        mask = (1 << 64) - 1
        for batch in batches:
            for k, fp, node in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key:
                    out += _spanning(fps, nodes, radius)
                    key, fps, nodes = k, [], []
                fps.append(fp & mask)
                nodes.append(node)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        out += _spanning(fps, nodes, radius)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """Per row: doc_id, fp (long) and component_id, the smallest id reachable over links of at most ``radius`` differing bits.

    Equal fingerprints fold into one node first, so copies never meet in pairs. Rows with a null id are left out of the
    smallest id; a fingerprint that only such rows have keeps a null component. Texts without words share fingerprint 0
    and are linked like any other.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # a row whose id occurs with several fingerprints would be one node for two: ids are taken to be unique
    nodes = cut(nodes, "nodes")
    roots = components(linked(nodes, radius, most))
    ids = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group - the one with the smallest id - with all its columns; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col, words, radius).where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


ship(__name__)
