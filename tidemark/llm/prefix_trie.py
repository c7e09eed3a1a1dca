"""The trie of all conversations' beginnings, each conversation rebuilt from another one's head and its own turns.

Nothing is rebuilt as text. A run of turns has a fingerprint, the product of its turns' digests in a polynomial hash modulo a
Mersenne prime; fingerprints of two runs compose to that of both, and what a head gave can be taken away again. So the
fingerprint of every beginning of a rebuilt conversation follows from those of the stored turns, to which its rows refer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, ship
from tidemark.session import cut

PRIME = (1 << 127) - 1
#: Factors of the polynomial hash; the next one is tried if the check finds two contents under one fingerprint.
FACTORS = (0x2545F4914F6CDD1D9E3779B97F4A7C15, 0x5851F42D4C957F2D14057B7EF767814F, 0x6C62272E07BB014262B821756295C58D)
HEADS = 20
MOST_HEAD = 3
#: Turns of one conversation that a task orders at a time.
WIDTH = 100_000
#: Ids in one piece of a node's list of ends.
CHUNK = 4_096


class Run:
    """Composition of fingerprints of runs of turns."""

    def __init__(self, factor: int, prime: int = PRIME):
        self.factor, self.prime, self.powers = factor % prime, prime, [1]

    def power(self, n: int) -> int:
        while len(self.powers) <= min(n, 4096):
            self.powers.append(self.powers[-1] * self.factor % self.prime)
        return self.powers[n] if n < len(self.powers) else pow(self.factor, n, self.prime)

    def add(self, run: int, digest: bytes) -> int:
        return (run * self.factor + int.from_bytes(digest, "big") + 1) % self.prime

    def join(self, run: int, following: int, n: int) -> int:
        """The run and then another one of n turns."""
        return (run * self.power(n) + following) % self.prime

    def without(self, whole: int, head: int, n: int) -> int:
        """The last n turns of a run that begins with the head."""
        return (whole - head * self.power(n)) % self.prime


def _pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _unpack(x: bytes | None) -> int:
    return int.from_bytes(x, "big") if x is not None else 0


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, digest, words): the digest stands for role and text, both lengths fixed by what precedes them."""
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    content = F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_)
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.substring(F.unhex(F.sha2(content, 256)), 1, 16).alias("digest"),
        F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"))


def _placed(turns: DataFrame, factor: int, prime: int) -> DataFrame:
    """(conv, place, digest, words, fp): turns in order, from 1, with the fingerprint of the conversation up to each.

    Rows are dealt out by range, so a conversation of any length spreads; each range composes for itself, and the few
    conversations that cross ranges get the composition of what lies before.
    """
    def within(batches):
        from pyspark import TaskContext

        runs, part, conv, place, fp = Run(factor, prime), TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            places, fps = [], []
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != conv:
                    conv, place, fp = c, 0, 0
                place, fp = place + 1, runs.add(fp, digest)
                places.append(place)
                fps.append(_pack(fp))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), batch.column(1),
                                              batch.column(2), pa.array(fps, pa.binary())], names=["conv", "part", "place", "digest", "words", "fp"])

    def carried(batches):
        runs = Run(factor, prime)
        for batch in batches:
            out = []
            for c, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = fp = 0
                for x in pieces:
                    out.append((c, x["part"], place, _pack(fp)))
                    place, fp = place + x["place"], runs.join(fp, _unpack(x["fp"]), x["place"])
            names = ["conv", "part", "before", "before_fp"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    def applied(batches):
        runs = Run(factor, prime)
        for batch in batches:
            places, fps = [], []
            for place, fp, before, before_fp in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5, 6))):
                if before:
                    place, fp = before + place, _pack(runs.join(_unpack(before_fp), _unpack(fp), place))
                places.append(place)
                fps.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(2), batch.column(3), pa.array(fps, pa.binary())],
                                             names=["conv", "place", "digest", "words", "fp"])

    # equal rows get keys of their own, so that no number of them makes one range
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("__n")]
    ranged = turns.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(ranged.select("conv", "digest", "words").mapInArrow(
        within, "conv long, part int, place long, digest binary, words long, fp binary"), "parts")
    # at most one conversation crosses from a range to the next: two rows per range
    crossing = parts.groupBy("conv", "part").agg(F.max("place").alias("place"), F.max_by("fp", "place").alias("fp")).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("part", "place", "fp"))).alias("pieces")).where(F.size("pieces") > 1)
    carry = crossing.mapInArrow(carried, "conv long, part int, before long, before_fp binary")
    return cut(parts.join(F.broadcast(carry), ["conv", "part"], "left").select("conv", "place", "digest", "words", "fp", "before", "before_fp")
               .mapInArrow(applied, "conv long, place long, digest binary, words long, fp binary"), "turns")


def _rebuilt(turns: DataFrame, factor: int, prime: int, base: Callable[[Column], Column], head: Callable[[Column], Column],
             most_head: int) -> tuple[DataFrame, DataFrame]:
    """(conv, n): every conversation and its rebuilt length, and its rows: conv, n, depth, fp, digest, words, ref_conv, ref_place."""
    first = F.when(F.col("place") <= most_head, F.struct("place", "digest", "words", "fp"))
    convs = cut(turns.groupBy("conv").agg(F.max("place").alias("own"), F.array_sort(F.collect_list(first)).alias("heads")), "heads")
    bases = convs.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    h = F.col("h")
    plan = convs.withColumns({"base": base(F.col("conv")), "h": head(F.col("conv")).cast("int")}).join(bases, "base", "left")
    taken = F.slice(F.coalesce("base_heads", F.array().cast(dict(bases.dtypes)["base_heads"])), F.lit(1), h)
    plan = plan.withColumn("taken", taken).select(
        "conv", "base", "h", "taken", F.size("taken").alias("k"), (F.size("taken") + F.greatest(F.col("own") - h, F.lit(0))).alias("n"),
        F.when(F.size("taken") > 0, F.element_at("taken", -1)["fp"]).alias("head_fp"),
        F.when((h > 0) & (F.col("own") > h), F.get("heads", h - 1)["fp"]).alias("own_fp"))
    plan = cut(plan, "plan")

    def composed(batches):
        runs = Run(factor, prime)
        for batch in batches:
            out = []
            for place, h, fp, head_fp, own_fp in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
                n = place - h
                own = runs.without(_unpack(fp), _unpack(own_fp), n) if own_fp is not None else _unpack(fp)
                out.append(_pack(runs.join(_unpack(head_fp), own, n)) if head_fp is not None else _pack(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[7:], pa.array(out, pa.binary())],
                                             names=["conv", "n", "place", "digest", "words", "depth", "fp"])

    own = turns.join(plan.select("conv", "h", "k", "n", "head_fp", "own_fp"), "conv").where(F.col("place") > h)
    own = own.select("conv", "n", "place", "h", "fp", "head_fp", "own_fp", "digest", "words", (F.col("place") - h + F.col("k")).alias("depth"))
    own = own.mapInArrow(composed, "conv long, n long, place long, digest binary, words long, depth long, fp binary")
    own = own.select("conv", "n", "depth", "fp", "digest", "words", F.col("conv").alias("ref_conv"), F.col("place").alias("ref_place"))
    heads = plan.select("conv", "n", "base", F.explode("taken").alias("t")).select(
        "conv", "n", F.col("t.place").alias("depth"), "t.fp", "t.digest", "t.words", F.col("base").alias("ref_conv"), F.col("t.place").alias("ref_place"))
    return plan.select("conv", "n"), cut(own.unionByName(heads), "rebuilt")


def _ends(rows: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, depth, ends): SHA-256 over each node's ids ``c`` in ascending order, joined by commas.

    Ids are sorted by range and joined in pieces by all tasks; only pieces of a node meet, one after the other.
    """
    def pieces(batches):
        node, first, ids, out = None, None, [], []

        def close():
            if ids:
                out.append((*node, first, ",".join(map(str, ids))))

        def batch_of():
            return pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.string())],
                                              names=["conv_id", "depth", "first", "ids"])

        for batch in batches:
            for a, d, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (a, d) != node or len(ids) >= chunk:
                    close()
                    node, first, ids = (a, d), c, []
                    if len(out) >= 512:
                        yield batch_of()
                        out = []
                ids.append(c)
        close()
        if out:
            yield batch_of()

    def digests(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for a, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, d) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, d), hashlib.sha256()
                    sha.update(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], pa.array([x[2] for x in out], pa.string())],
                                             names=["conv_id", "depth", "ends"])
            out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([sha.hexdigest()])],
                                             names=["conv_id", "depth", "ends"])

    order = ["conv_id", "depth", "c"]
    joined = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "conv_id long, depth long, first long, ids string")
    keys = ["conv_id", "depth", "first"]
    return joined.repartition("conv_id", "depth").sortWithinPartitions(*keys).mapInArrow(digests, "conv_id long, depth long, ends string")


def rebuilt_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  base: Callable[[Column], Column] = lambda c: c - c % HEADS,
                  head: Callable[[Column], Column] = lambda c: F.crc32(c.cast("string").cast("binary")) % (MOST_HEAD + 1),
                  most_head: int = MOST_HEAD, factors: tuple[int, ...] = FACTORS, prime: int = PRIME) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, rows, nodes) of the rebuilt conversations, as :func:`prefix_trie` takes them.

    A row per rebuilt turn refers to a stored one (``ref_conv``, ``ref_place``) and has the fingerprint of all up to it. Rows of one
    depth and fingerprint are a node; it is right if all refer to turns of one content, since one content more leads back
    to one shorter beginning. Were two contents to meet in a node, the next factor is tried.
    """
    turns = _turns(conversations, conv, turn, role, text)
    for factor in factors:
        convs, rows = _rebuilt(_placed(turns, factor, prime), factor, prime, base, head, most_head)
        nodes = cut(rows.groupBy("depth", "fp").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("n").alias("longest"),
            F.min("digest").alias("lo"), F.max("digest").alias("hi")), "nodes")
        if nodes.where("lo != hi").isEmpty():
            return convs, rows, nodes.drop("lo", "hi")
    raise ValueError("two contents under one fingerprint with every factor")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                width: int = WIDTH, chunk: int = CHUNK, **options) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (nulls first), ties by their content's digest; a null role or text counts as empty, rows with
    a null conversation take no part, repeated rows are turns of their own. Conversation c is rebuilt from the first
    ``head(c)`` turns of ``base(c)`` - all if it has fewer, none if it doesn't exist - and its own turns after that many. Nodes
    are the distinct beginnings, the root (depth 0) included; an empty table has none. Other columns are not looked at.

    What a subtree sums up reaches a node through its members: each node counts for its smallest conversation only, and a
    conversation hands to each of its beginnings what it counts from there on. So one ordered pass per conversation and one
    aggregate do for any depth. A conversation of over ``width`` turns goes through it in pieces.
    """
    convs, rows, nodes = rebuilt_turns(conversations, conv, turn, role, text, **options)
    mine = F.col("conv") == F.col("conv_id")
    seen = cut(rows.select("conv", "n", "depth", "fp", "words").join(nodes, ["depth", "fp"]).select(
        "conv", "n", "depth", F.when(F.col("n_convs") > 1, F.col("fp")).alias("fp"), "conv_id", "n_convs",
        F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"),
        F.when(mine & (F.col("longest") == F.col("depth")), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(mine, 1).otherwise(0).cast("long").alias("new"), F.floor((F.col("depth") - 1) / width).alias("piece")), "members")
    w = Window.partitionBy("conv", "piece").orderBy(F.col("depth"))
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    passed = seen.select("conv", "n", "depth", "fp", "conv_id", "n_convs", "piece", F.sum("saved").over(rest).alias("saved"),
                         F.sum("leaf").over(rest).alias("leaves"), F.lead("new").over(w).alias("children"), F.lag("conv_id").over(w).alias("parent"))
    light = passed.where(F.col("n") <= width)
    pieces = seen.where(F.col("n") > width).groupBy("conv", "piece").agg(
        F.sum("saved").alias("s"), F.sum("leaf").alias("l"), F.min_by("new", "depth").alias("f"), F.max_by("conv_id", "depth").alias("p"))
    by = Window.partitionBy("conv").orderBy("piece")
    later = by.rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.select("conv", "piece", F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l"), F.lead("f").over(by).alias("f"),
                           F.lag("p").over(by).alias("p"))
    heavy = passed.where(F.col("n") > width).join(pieces, ["conv", "piece"]).withColumns({
        "saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0)),
        "children": F.coalesce("children", "f"), "parent": F.coalesce("parent", "p")}).drop("s", "l", "f", "p")
    passed = light.unionByName(heavy).withColumn("children", F.coalesce("children", F.lit(0)))

    # a node of one conversation has its sums already
    own_end = F.when(F.col("n") == F.col("depth"), F.sha2(F.col("conv").cast("string"), 256))
    single = passed.where("n_convs = 1").select("conv_id", "depth", "parent", "n_convs", "children", "leaves", "saved", own_end.alias("end"))
    several = passed.where("n_convs > 1").groupBy("depth", "fp").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min("n_convs").alias("n_convs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).drop("fp").withColumn("end", F.lit(None).cast("string"))
    found = cut(single.unionByName(several), "found")

    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    ends = cut(seen.where("n_convs > 1 AND n = depth").select("conv_id", "depth", F.col("conv").alias("c")).unionByName(
        convs.where("n = 0").select(root.select("conv_id").scalar().alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv").alias("c"))), "ends")
    top = found.where("depth = 1").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = top.select(F.struct("children", "leaves", "saved")).scalar()
    roots = root.where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs",
                                             tops.alias("t")).select(
        "conv_id", "depth", "parent", "n_convs", F.col("t.children").alias("children"), F.coalesce("t.leaves", F.lit(1).cast("long")).alias("leaves"),
        F.coalesce("t.saved", F.lit(0).cast("long")).alias("saved"), F.lit(None).cast("string").alias("end"))
    below = found.withColumn("parent", F.when(F.col("depth") == 1, root.select("conv_id").scalar()).otherwise(F.col("parent")))
    return below.unionByName(roots).join(_ends(ends, chunk), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("end", "ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ship(__name__)
