import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.util import clashing, frame
from tidemark.llm import toxicity as T

TERMS = [("moron", False), ("worthless", False), ("idiot", False), ("scum", False), ("disgust", True), ("ab", False)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def brute(word):
    best = []
    for i, (t, stem) in enumerate(TERMS):
        ends = distance(t, word)
        e = min(ends) if stem else ends[-1]
        if e <= T.errors(t, stem):
            best.append((e, i))
    return min(best, default=None)


AUTOMATON = T.Automaton(TERMS)


def edited(word, edits):
    for at, new in edits:
        word = word[:at] + new + word[at + 1:]
    return word


EDITS = st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "x", "o", "m", "ss", "1"])), max_size=3)


@settings(max_examples=600, deadline=None)
@given(st.builds(edited, st.sampled_from([t for t, _ in TERMS] + ["disgusting"]), EDITS) | st.text("abdegimorstuw", max_size=10))
def test_automaton_equals_edit_distance(word):
    assert AUTOMATON.match(word) == brute(word)


def test_automaton_starts_over(monkeypatch):
    monkeypatch.setattr(T, "MOST_STATES", 3)
    a = T.Automaton(TERMS)
    assert [a.match(w) for w in ("moron", "m0ron", "wrothles", "disgustingly", "house")] == [brute(w) for w in ("moron", "m0ron", "wrothles", "disgustingly", "house")]


def corpus(n=600, seed=4):
    rnd = random.Random(seed)
    calm = "river garden bright music window paper letter market winter forest silver orange".split()
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(calm) for _ in range(60)]
        kind = i % 6
        if kind == 0:  # abuse
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["you moron", "worthless idiot", "scum"])
        if kind == 1:  # quotation
            words[20] = 'someone said " ' + rnd.choice(["you moron", "worthless idiot", "scum"]) + ' " and left'
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(kind == 0)))
    return rows, labels


def test_learns_abuse_misspelling_and_quotation(spark):
    rows, labels = corpus()
    df, lab = clashing(frame(spark, rows)), frame(spark, labels + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = T.fit(df, lab, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in T.score(df, model, keep=[F.lit(1).alias("held_out")]).collect()}
    new = [i for i, _ in labels if i >= 400]
    assert sum(got[i].predicted == y for i, y in labels if i >= 400) >= 0.97 * len(new)
    s = model.score
    calm = "river garden bright music window paper letter market winter forest " * 5
    assert s(calm + "you m0ron worthles idiott") > 0.5 > s(calm)
    assert s(calm + 'he wrote " you moron " there ' + calm) < 0.5
    kept = T.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_edges(spark):
    rows, labels = corpus(60)
    df = frame(spark, rows)
    none = T.fit(df, frame(spark, [(1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert {r.predicted for r in T.score(df, none).collect()} == {0}
    model = T.fit(df, frame(spark, labels, "doc_id long, toxic int"), F.lit(True))
    odd = frame(spark, [(None, None, None, None, None), (1, "", None, None, None), (2, "moron " * 30_000, None, None, None), (2, "moron " * 30_000, None, None, None)])
    assert all(0 <= r.score <= 1 for r in T.score(odd, model).collect())
    assert T.score(df.limit(0), model).count() == 0
