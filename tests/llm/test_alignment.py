"""Alignment against whole texts encoded by both libraries and sets of byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.util import clashing, docs, frame
from tidemark.llm import alignment as A

BYTE, PIECE = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOKENIZER = Tokenizer.from_file(BYTE)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE)
ALIGNER = A.Aligner(BYTE, PIECE)
ODD = ["a\t \tb", "x \n y", "tab\t end", " lead", "trail ", "two  blanks", "a▁b", "<|endoftext|> here <s> </s>", "İ! ﬁ ①   z", "\x00", " ",
       "\U0001f600 日本語", "it's we'll 'tis", "\r\n a\r b", "x   y", "é é", "​ ​"]


def brute(text):
    """(A's ids, B's ids, groups), or None."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    ta = [TOKENIZER.decode([i]).encode() for i in a]
    ends = []
    for i, t in zip(a, ta):
        name = TOKENIZER.id_to_token(i)
        ends.append((ends[-1] if ends else 0) + len(name))  # a character of a name is a byte
    tb = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(tb) != whole or ends[-1] != len(whole):
        return None
    at, other = {e: n for n, e in enumerate(ends)}, 0
    groups, links, i0, j0 = [], [], 0, 0
    for j, t in enumerate(tb):
        other += len(t)
        if other in at:
            i = at[other]
            groups.append((a[i0:i + 1], b[j0:j + 1]))
            links.append((a[i], b[j]))
            i0, j0 = i + 1, j + 1
    return a, b, groups, links


def text_of(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def check(spark, texts, wrap=lambda df: df):
    df = wrap(docs(spark, texts))
    found = [brute(t) for t in texts]
    count = Counter(x for f in found if f for x in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    want = {}
    for i, f in enumerate(found):
        want[i] = (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]),
                   text_of(f[2])) if f else (0, 0, 0, 0, 0, 0, "")
    assert {r.doc_id: tuple(r)[1:] for r in A.aligned(df, BYTE, PIECE).collect()} == want
    hashed = {r.doc_id: r.groups for r in A.aligned(df, BYTE, PIECE, digest=True).collect()}
    assert hashed == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "" for i, w in want.items()}
    return want


def test_galloping():
    rnd = random.Random(1)
    for _ in range(3000):
        n = rnd.choice([5, 40, 3000])
        a, b = (sorted(rnd.sample(range(n), rnd.randint(0, min(n, rnd.choice([3, 60]))))) for _ in range(2))
        assert A.common_ends(a, b) == [(a.index(x), b.index(x)) for x in a if x in b]


def test_equals_whole_texts(spark):
    given_ = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = check(spark, given_ + ODD + [None, "", "same words"] + ["same words"] * 3)
    assert sum(w[0] > 0 for w in want.values()) > 200 and want[len(given_) + 6][0] == 0
    check(spark, ODD + [None, ""], clashing)


def test_rows_without_id_and_no_rows(spark):
    odd = frame(spark, [(None, "one two", "", "", 0), (None, "one two", "", "", 0), (3, "two", "", "", 0)])
    got = A.aligned(odd, BYTE, PIECE).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "None", "None"] and len({r.count_sum for r in got if r.doc_id is None}) == 1
    assert A.aligned(odd.limit(0), BYTE, PIECE).count() == 0


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    check(spark, ["".join(rnd.choice("ab \n") for _ in range(60_000)), "word" * 20_000, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20_000))])


@settings(max_examples=1500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b ▁ab'́.!<|>"), st.characters(exclude_categories=["Cs"])), max_size=24))
def test_pieces_give_the_whole(text):
    got = ALIGNER.entries(ALIGNER.pieces(text)) if text else [()]
    want = brute(text)
    if () in got:
        assert want is None
    else:
        assert want and ";".join(e[3] for e in got) == text_of(want[2])
