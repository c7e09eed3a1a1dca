import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.util import WORD, clashing, docs, frame, low
from tidemark.llm import simhash as S
from tidemark.llm.components import components


def brute_print(text, words=3):
    w = WORD.findall(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[j:j + words]).encode(), 42) for j in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def brute_groups(fps, radius=2):
    ids = sorted(fps)
    return groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= radius], ids)


TEXTS = [None, "", " \t ", "One", "one two", "ONE two", "one two three", "É é", *["copy of a text with some words"] * 12,
         "a\x0bb\x0cc d e f", "word " * 50_000]


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    base = ["alpha beta gamma delta epsilon zeta eta theta".split()[rnd.randrange(8)] + str(rnd.randrange(50)) for _ in range(900)]
    texts = TEXTS + [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in range(0, 900, 30)] + [" ".join(rnd.choice(base) for _ in range(40)) for _ in range(30)]
    got = {r.doc_id: r for r in S.near_duplicates(clashing(docs(spark, texts))).collect()}
    fps = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    want = brute_groups(fps)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(texts) - 20
    kept = S.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    shown = S.near_duplicates(docs(spark, ["x"])).select(S.as_hex(F.col("fp")).alias("h")).first().h
    assert shown == f"{brute_print('x'):016x}"


@pytest.mark.parametrize("most", [4_096, 5])
def test_links_lose_nothing_in_hot_shards(spark, most):
    """Shards beyond the limit are dealt out again; all fingerprints here share most of their bits."""
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(160)} | {rnd.getrandbits(64) for _ in range(40)}
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()]
    links = S.linked(spark.createDataFrame(signed, "fp long, node long"), 2, most)
    got = groups([(r.a, r.b) for r in links.collect()], fps)
    assert got == brute_groups(fps)


def test_tree_finds_all_within(spark):
    rnd = random.Random(1)
    fps = [rnd.getrandbits(12) for _ in range(400)]
    tree = S.BKTree()
    for f in fps:
        tree.add(f)
    for q in range(0, 4096, 37):
        assert sorted(tree.search(q, 2)) == sorted({f for f in fps if (f ^ q).bit_count() <= 2})


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)]
    nodes = {n for p in pairs for n in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == groups(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    assert S.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    odd = frame(spark, [(None, "same words here", "", "", 0), (4, "same words here", "", "", 0), (4, "same words here", "", "", 0), (None, "only this one", "", "", 0)])
    assert sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(odd).collect()), key=str) == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
