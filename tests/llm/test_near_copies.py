"""The pipeline's near-duplicate stage against brute force at a five-word Jaccard of 0.8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import groups as linked_groups
from tests.llm.util import WORD, clashing, docs, frame, low
from tidemark.llm import near_copies as N
from tidemark.llm.simhash import majority

SF = "/root/testdata/sf0.001"


def brute_set(text, words=5):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_pairs(texts, least=0.8):
    sets = {i: brute_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def with_copies(spark, seed=5):
    """sf0.001 texts of 60 to 800 words, and two copies of each with 1 to 5 words replaced."""
    rnd = random.Random(seed)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if 60 <= len((r.text or "").split()) <= 800]
    out = list(texts)
    for t in texts * 2:
        w = t.split()
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [500, 7])
def test_stage_equals_brute_force(spark, most):
    texts = dict(enumerate(with_copies(spark) + [None, "", " \t", "One", "ONE", "one two three"]))
    pairs = brute_pairs(texts)
    df = docs(spark, list(texts.values()))
    stage = corpus_pipeline.drop_near_copies(spark, df, SF) if most == 500 else N.keep_one(clashing(df), most=most)
    want = linked_groups(pairs, texts)
    assert len(pairs) > 100
    assert sorted(r.doc_id for r in stage.collect()) == sorted(i for i in texts if want[i] == i)


def test_one_large_group(spark):
    """All share most words; parts of ten meet in pairs, and links cross the parts."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(90):
        base[rnd.randrange(80)] = f"x{i}"
        texts[i] = " ".join(base)
    got = {r["__row"]: r.group for r in N.groups(docs(spark, list(texts.values())).withColumn("__row", F.col("doc_id")), most=10).collect()}
    want = linked_groups(brute_pairs(texts), texts)
    first = {}
    assert all(first.setdefault(want[i], got[i]) == got[i] for i in texts) and len(set(first.values())) == len(first)


def test_null_repeated_and_no_rows(spark):
    odd = frame(spark, [(None, "same words here", "", "", 0), (4, "same words here", "", "", 0), (4, "same words here", "", "", 0),
                        (4, "quite another text", "", "", 0), (None, "only this one", "", "", 0)])
    assert sorted(((r.doc_id, r.text) for r in N.keep_one(odd).collect()), key=str) == sorted(
        [(None, "same words here"), (4, "same words here"), (4, "quite another text"), (None, "only this one")], key=str)
    assert N.keep_one(odd.limit(0)).count() == 0


def test_mixing_after_the_stage(spark):
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    before = spark.createDataFrame(kept.collect(), kept.schema)
    taken = {}
    for r in corpus_pipeline.mix_sources(spark, before, SF).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert taken == {i: v[3] for i, v in brute_mix([(r.doc_id, r.text, r.source) for r in before.collect()]).items() if v[3]}


def test_fingerprints_in_a_tree_find_the_candidates():
    """Pairs at 0.8 lie within the radius; the tree finds what is near without a shared band, and nothing beyond the radius."""
    random = np.random.default_rng(1)
    nodes, sets, pairs = [], [], 0
    for n in [9, 36, 90, 450] * 60:
        common, own = random.integers(0, 1 << 64, 8 * n // 9, np.uint64), random.integers(0, 1 << 64, 2 * (n // 9), np.uint64)
        for half in np.split(own, 2):
            sets.append(np.unique(np.concatenate([common, half])))
            nodes.append(len(nodes))
        pairs += 1
    found = N._links(nodes, sets, 0.8)
    assert sorted(found) == [(2 * k + 1, 2 * k) for k in range(pairs)]
    far = sum((majority(sets[2 * k]) ^ majority(sets[2 * k + 1])).bit_count() > 8 for k in range(pairs))
    assert far > pairs / 2 and len(N._links(nodes, sets, 0.8, 8)) == pairs - far


def test_links_beyond_the_radius_are_found():
    """Sets at 0.8 whose fingerprints differ in all 64 bits; and in small sets whatever brute force finds, with no set compared or linked twice."""
    full, h, g = (1 << 64) - 1, 0x0123456789ABCDEF, 0x5A5AF00F12345678
    four = np.unique(np.array([h, full ^ h, g, full ^ g], np.uint64))
    five = np.unique(np.append(four, np.uint64(full)))
    assert (majority(four) ^ majority(five)).bit_count() == 64 and N._links([7, 9], [four, five], 0.8) == []
    assert N._every_link([7, 9], [four, five], 0.8) == [(9, 7)]
    random = np.random.default_rng(4)
    sets = []
    for n in [4, 5, 9, 10, 18, 60] * 20:
        base = random.integers(0, 1 << 64, n, np.uint64)
        sets += [np.unique(base), np.unique(np.append(base, random.integers(0, 1 << 64, max(1, n // 5), np.uint64))), np.unique(base[1:])]
    nodes = list(range(len(sets)))
    pairs = [(a, b) for a in nodes for b in nodes[:a] if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8]
    for radius in (N.RADIUS, 0):  # with a tree that finds next to nothing as well
        links, N_links = [], N._links
        try:
            N._links = lambda nodes, sets, least: N_links(nodes, sets, least, radius)
            links = N._every_link(nodes, sets, 0.8)
        finally:
            N._links = N_links
        assert set(map(frozenset, links)) <= set(map(frozenset, pairs))
        assert linked_groups(links, dict.fromkeys(nodes)) == linked_groups(pairs, dict.fromkeys(nodes))
