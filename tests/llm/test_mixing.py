import hashlib

import pytest

from tests.llm.util import WORD, clashing, docs, frame
from tidemark.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; what is over goes out again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        out = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if out[s] > most * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: most * sizes[s] for s in over}


def brute(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    goal = targets(sizes)
    out = {}
    for s in sizes:
        own = sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest())
        want = int(goal[s] + 0.5)
        left = want % sizes[s] if sizes[s] else 0
        for i in own:
            part = min(size[i], left)
            left -= part
            out[i] = (size[i], sizes[s], pytest.approx(goal[s]), (want // sizes[s] * size[i] if sizes[s] else 0) + part)
    return out


ROWS = [(i, " ".join(["w"] * (i * 7 % 40)), "big" if i % 3 == 0 else ["a", "b", "c", "é", None][i % 5]) for i in range(200)] + [
    (200, None, "empty"), (201, "", "empty"), (202, " \t\n", "tiny"), (203, "x\x0by z", "tiny"), (204, "w " * 50_000, "a")]


@pytest.mark.parametrize("bucket_rows", [2_000, 7])
def test_equals_brute_force(spark, bucket_rows):
    df = clashing(frame(spark, [(i, t, "en", s, 0) for i, t, s in ROWS]))
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(df, bucket_rows=bucket_rows).collect()}
    assert got == brute(ROWS)


def test_mixed_rows_hold_what_is_taken(spark):
    df = clashing(frame(spark, [(i, t, "en", s, len(t) if t else 0) for i, t, s in ROWS]))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {i: v[3] for i, v in brute(ROWS).items() if v[3]}


def test_edges(spark):
    df = docs(spark, ["a b", "c"])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    twice = frame(spark, [(1, "a b c", "en", "s", 0)] * 4)
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 18


def test_mixed_takes_repeated_and_null_ids_once_each(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 4 + [(None, "d e", "en", "s", 3), (None, "f g", "en", "s", 3), (2, "h", "en", "s", 1)]
    out = [r.text for r in mixing.mixed(frame(spark, rows)).collect()]
    assert sum(len(t.split()) for t in out) == round(1.5 * 17)
    assert 4 <= sum(t.startswith("a") for t in out) <= 8 and sum(t == "a b c" for t in out) <= 8
    assert all(1 <= sum(t.startswith(x) for t in out) <= 2 for x in "dfh")
    many = mixing.mixed(frame(spark, [(7, "x y", "en", "s", 3)] * 500 + [(i, "x y", "en", "t", 3) for i in range(500)]))
    assert sum(len(r.text.split()) for r in many.collect()) == 3000
