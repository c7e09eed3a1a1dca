"""The trie of rebuilt conversations against a plain dictionary of their beginnings."""

import hashlib
import random

import pytest

from tests.llm.util import WORD, clashing, crc, frame
from tidemark.llm import prefix_trie as T

TURNS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows, head=lambda c: crc(c) % 4, base=lambda c: c - c % 20):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {c: tuple(own.get(base(c), [])[:head(c)] + t[head(c):]) for c, t in own.items()}
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = {}
    for node, found in members.items():
        below = [m for m in members if m[:len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1] if m else "")) for m in below)
        leaves = sum(not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in below) for m in below)
        ends = ",".join(map(str, sorted(c for c in found if len(rebuilt[c]) == len(node))))
        out[min(found), len(node)] = (min(members[node[:-1]]) if node else None, len(found), len(children), leaves, saved,
                                      hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(spark, rows, wrap=lambda df: df, parts=4, **options):
    got = T.prefix_trie(wrap(frame(spark, rows, TURNS, parts)), **options).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(found) == len(got) and found == brute(rows)
    return found


def made(seed, n=140, same=6, longest=9):
    rnd = random.Random(seed)
    words = [" ".join("abc"[rnd.randrange(3)] for _ in range(rnd.randint(0, 4))) for _ in range(same)]
    rows = []
    for c in rnd.sample(range(300), n):
        shared = rnd.random() < 0.4
        for t in range(rnd.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 else "assistant", words[(t if shared else rnd.randrange(same)) % same]))
    return rows


def test_equals_brute_force(spark):
    found = check(spark, made(1))
    assert max(v[1] for v in found.values()) > 20 and max(d for _, d in found) >= 8


def test_long_conversations_in_pieces(spark):
    """Pieces of three turns, chunks of two ids and many ranges: every composition across an edge counts."""
    rows = made(2, 60, 3, 30)
    check(spark, rows, parts=13, width=3, chunk=2)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(20, None, "user", "first"), (20, 0, None, "x y"), (20, 0, None, "x y"), (20, 0, "user", None), (20, None, "a", "b"), (21, 1, "", ""),
            (22, 1, None, None), (None, 1, "user", "lost"), (23, 5, "user", "x y"), (40, 0, "u", "one"), (47, 0, "u", "one"), (47, 1, "u", "two"),
            (68, 0, "u", "alone")] + [(c, 0, "u", "one") for c in range(100, 130)]
    check(spark, rows)
    check(spark, rows, wrap=clashing)


def test_turnless_and_no_rows(spark):
    short = [(c, 0, "u", "x") for c in range(1, 19)]  # no base exists: whoever has h > 0 has no turn left
    found = check(spark, short)
    assert found[1, 0][1] == 18
    check(spark, [x for x in short if crc(x[0]) % 4][:3])
    assert T.prefix_trie(frame(spark, short, TURNS).limit(0)).count() == 0


def test_one_conversation_has_most_rows(spark):
    rows = [(40, t, "u", f"turn {t % 5}") for t in range(700)] + [(41, t, "u", f"turn {t % 5}") for t in range(20)] + made(4, 30)
    turns = T._turns(frame(spark, rows, TURNS), "conv_id", "turn", "role", "text")
    placed = T._placed(turns, T.FACTORS[0], T.PRIME).collect()
    assert sorted((r.conv, r.place) for r in placed if r.conv == 40) == [(40, i) for i in range(1, 701)]
    options = {"base": lambda c: c - c % 20, "width": 50}
    got = {(r.conv_id, r.depth): r.n_leaves for r in T.prefix_trie(frame(spark, rows, TURNS), **options).collect()}
    assert got[40, 700] == 1


def test_a_false_meeting_is_found(spark):
    """Modulo a small prime contents share fingerprints: the factors are given up one after the other."""
    with pytest.raises(ValueError, match="every factor"):
        T.prefix_trie(frame(spark, made(5), TURNS), prime=13)
    turns = frame(spark, made(5, 40), TURNS)
    weak = T.prefix_trie(turns, factors=(1, T.FACTORS[0]))  # with factor 1 the order of turns doesn't count
    assert {(r.conv_id, r.depth) for r in weak.collect()} == set(brute(made(5, 40)))


def test_rows_refer_to_stored_turns(spark):
    rows = made(6, 50)
    convs, rebuilt, _ = T.rebuilt_turns(frame(spark, rows, TURNS))
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        own.setdefault(c, []).append((role, text))
    got = {}
    for r in rebuilt.orderBy("conv", "depth").collect():
        got.setdefault(r.conv, []).append(own[r.ref_conv][r.ref_place - 1])
    assert got == {c: t for c in own if (t := own.get(c - c % 20, [])[:crc(c) % 4] + own[c][crc(c) % 4:])}
    assert convs.count() == len(own)
