"""Repeated windows against a plain dictionary of all windows."""

import random

import pytest

from tests.llm.util import WORD, clashing, docs, frame
from tidemark.llm import substrings as S


def brute(rows, words=13):
    """{(id, text): (n_words, n_removed, kept)} of (id, text) rows."""
    first, split = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - words + 1):
                key = tuple(w[p:p + words])
                first[key] = min(first.get(key, i), i)
    out = {}
    for (i, t), (_, w) in zip(rows, split):
        gone = set()
        for p in range(len(w) - words + 1):
            if i is not None and first[tuple(w[p:p + words])] < i:
                gone.update(range(p, p + words))
        out[i, t] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def check(spark, rows, words=13, block=None, wrap=lambda df: df, parts=3):
    df = wrap(frame(spark, [(i, t, "", "", 0) for i, t in rows], parts=parts))
    got = sorted(((r.doc_id, *map(r.__getitem__, ("n_words", "n_removed", "kept"))) for r in S.drop_repeated(df, words=words).collect()), key=str)
    want = brute(rows, words)
    assert got == sorted(((i, *want[i, t]) for i, t in rows), key=str)
    return sum(r[2] for r in got)


def made(seed, n=120, vocabulary=400):
    rnd = random.Random(seed)
    some = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(5, 160))] for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5:
                p = rnd.choice(some)
                a = rnd.randrange(len(p))
                w += p[a:a + rnd.randint(1, 150)]
            else:
                w += [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(0, 60))]
        out.append((rnd.randrange(10**6) * 1000 + i, rnd.choice([" ", "\n", " \t"]).join(w)))
    return out + [(x + 1, t) for x, t in out[:9]]


@pytest.mark.parametrize("words", [13, 50, 5, 30])
def test_equals_brute_force(spark, words):
    assert check(spark, made(words), words) > 0


def test_small_blocks(spark, monkeypatch):
    """Blocks of a few words send almost everything through the exchange."""
    monkeypatch.setattr(S, "BLOCK_WORDS", 50)
    assert check(spark, made(3), 13) > 0
    assert check(spark, made(4), 50) > 0


def test_edges(spark):
    line = " ".join(f"x{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line), (5, f"before {line} after"), (6, " ".join(line.split()[:12])),
            (7, line.upper()), (8, line.replace(" ", " ")), (9, "same " * 300), (10, "same " * 12), (11, "same " * 40), (12, f"{line}\n{line}")]
    assert check(spark, rows) > 0
    assert check(spark, rows, wrap=clashing) > 0


def test_repeated_rows_and_null_ids(spark):
    line, other = " ".join(f"x{i}" for i in range(20)), " ".join(f"y{i}" for i in range(20))
    rows = [(None, line), (None, line), (3, line), (3, line), (3, f"{line} {other}"), (4, other), (4, other), (2, other)]
    assert check(spark, rows) > 0
    assert check(spark, rows[:2]) == 0


def test_no_rows(spark):
    assert S.drop_repeated(docs(spark, ["x"]).limit(0)).count() == 0


def test_long_texts_and_a_hot_line(spark):
    rnd = random.Random(8)
    hot = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, f"{hot} " * (i % 3 + 1) + " ".join(f"v{rnd.randrange(5000)}" for _ in range(rnd.choice([0, 20, 30_000 if i % 40 == 0 else 50])))) for i in range(160)]
    assert check(spark, rows, parts=9) > 0


def test_levels():
    assert [S.levels(n) for n in (13, 50, 12, 5, 1)] == [[7, 13], [7, 13, 25, 50], [6, 12], [3, 5], [1, 1]]
