import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.util import clashing, docs, frame
from tidemark.llm import packing, token_store
from tidemark.llm.tokens import Encoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
BITS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "é", "ß", "Σ", "'s", "'", "don't", "<|endoftext|>", "<|", "|>", "12", "3.5", "…", "“x”", " ", "\x1c", "😀",
        "中文", "-", "foo.", "Foo,", "bar!!", "\r\n", " \n", "ñ", "_", "x_y", "²", "Ⅷ"]
ENCODERS = {n: Encoder(str(public_tokenizers.path(n)), keep=50) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(BITS) | st.text(max_size=4), max_size=12))
def test_pieces_give_the_ids_of_the_whole(name, parts):
    text = "".join(parts)
    e = ENCODERS[name]
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_letters_beside_punctuation(name):
    e = ENCODERS[name]
    texts = [f"{c}{p} {p}{c} {c}" for c in map(chr, range(0x41, 0x250)) if c.isalpha() for p in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    texts += ["İ! and more", "aİ_", "a\t \tb", "a\t ", "\t b", " \t"]
    for text, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want.ids, text


@settings(max_examples=150, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=600), block=st.sampled_from([1, 7, 64, 512]), percentile=st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(ids, block, percentile):
    data = token_store.encode_ids(np.array(ids, np.uint32), block, percentile)
    assert token_store.decode_ids(data).tolist() == ids
    for b in range(-(-len(ids) // block)):
        assert token_store.decode_block(data, b).tolist() == ids[b * block:(b + 1) * block]


def test_outliers_are_exceptions():
    ids = np.array([5] * 450 + [40_000] * 40, np.uint32)
    assert len(token_store.encode_ids(ids)) < 40 * 6 + 100


TEXTS = ["Hello world, hello!", None, "", "long text " * 20_000, *[f"doc number {i}." for i in range(60)]]


def ids_of(name, text, end):
    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def test_store_equals_brute_force(spark):
    path = str(public_tokenizers.path(NAMES[0]))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.round_trip(clashing(docs(spark, TEXTS)), path, 2).collect()}
    want, at = {}, 0
    for i, t in enumerate(TEXTS):
        ids = np.array(ids_of(NAMES[0], t, 2), "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_store_edges(spark):
    path = str(public_tokenizers.path(NAMES[0]))
    assert token_store.round_trip(docs(spark, ["a"]).limit(0), path, 2).count() == 0
    rows = token_store.round_trip(frame(spark, [(None, "a", "", "", 0), (3, "b c", "", "", 0), (3, "b c", "", "", 0)]), path, 2).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows if r.doc_id) == [(3, 2, 3), (3, 5, 3)]
    assert [(r.start, r.n_tokens) for r in rows if r.doc_id is None] == [(0, 2)]


def test_packing_places_every_id_once(spark):
    path = str(public_tokenizers.path(NAMES[1]))
    rows = packing.pack(clashing(docs(spark, TEXTS)), path, 0).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids, at = np.array(ids_of(NAMES[1], t, 0), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(docs(spark, ["a"]).limit(0), path, 0).count() == 0


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=80), tokens=st.sampled_from([8, 64, 100]), segments=st.integers(1, 6),
       loss=st.sampled_from([3, 40, 100]), pool=st.sampled_from([2, 5, 64]))
def test_packer_keeps_all_limits(sizes, tokens, segments, loss, pool):
    out = []
    p = packing.Packer(lambda *a: out.append(a), tokens, segments, min(loss, tokens), pool)
    for i, (n, free) in enumerate(sizes):
        p.add(i, 0, n, min(free, n))
    p.finish()
    at, used = {}, {}
    for owner, start, length, seq, offset, bears in sorted(out):
        assert start == at.get(owner, 0) and length > 0
        at[owner] = start + length
        free = min(sizes[owner][1], sizes[owner][0])
        assert bears == max(0, start + length - max(free, start))
        used.setdefault(seq, []).append((offset, length, bears))
    assert at == {i: n for i, (n, _) in enumerate(sizes)}
    for own in used.values():
        own.sort()
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:j]) for j in range(len(own))]
        assert sum(n for _, n, _ in own) <= tokens and len(own) <= segments and sum(b for _, _, b in own) <= min(loss, tokens)


def test_little_padding():
    rnd, out = random.Random(5), {}
    p = packing.Packer(lambda owner, start, length, seq, offset, bears: out.__setitem__(seq, out.get(seq, 0) + length))
    for i in range(5_000):
        p.add(i, 0, int(rnd.lognormvariate(6, 1.3)) + 1)
    p.finish()
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in out.values()) == 0
