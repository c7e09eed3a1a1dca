import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.util import clashing, frame
from tidemark.llm import language

WORDS = {"en": "the and house of water thing with mother that green", "de": "der und haus von wasser ding mit mutter dass grün schön", "fr": "le et maison de eau chose avec mère que vert être"}


def text(lang, n, rnd):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def corpus():
    rnd = random.Random(1)
    return [(i, text(lang, 30, rnd), lang, "s", 0) for i, lang in enumerate(list(WORDS) * 30)]


def brute(training, languages, string):
    """Code lengths by walking contexts from the longest down, in plain dicts."""
    out = {}
    data = b"\n\n\n" + string.lower().encode()
    for lang in languages:
        seen = {}
        for t in training[lang]:
            b = b"\n\n\n" + t.lower().encode()
            for i in range(3, len(b)):
                for k in range(4):
                    c = seen.setdefault(b[i - k:i], {})
                    c[b[i]] = c.get(b[i], 0) + 1
        bits = 0.0
        for i in range(3, len(data)):
            for k in (3, 2, 1, 0):
                c = seen.get(data[i - k:i])
                if c is None:
                    continue
                total = sum(c.values()) + len(c)
                if data[i] in c:
                    bits -= math.log2(c[data[i]] / total)
                    break
                bits -= math.log2(len(c) / total)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_equal_brute_force(spark):
    rows = corpus()
    model = language.fit(frame(spark, rows), F.lit(True))
    training = {lang: [t for _, t, k, _, _ in rows if k == lang] for lang in WORDS}
    for s in ["", "a", "the house", "schön ist das Wasser", "zzz 中文 qx", "être ou \x00 ÿ", "mit mother maison " * 20]:
        got = dict(zip(model.languages, model.bits(s)))
        assert got == pytest.approx(brute(training, WORDS, s), rel=1e-5, abs=1e-4)


def test_predictions_and_edges(spark):
    rnd = random.Random(9)
    df = frame(spark, corpus())
    model = language.fit(df, F.col("doc_id") % 2 == 0)
    new = [(i, text(lang, 12, rnd), lang, "s", 0) for i, lang in enumerate(list(WORDS) * 20)]
    new += [(900, None, None, None, None), (901, "", None, None, None), (902, "12 345 !?", None, None, None), (903, "der haus " * 30_000, "de", None, None)]
    got = {r.doc_id: r for r in language.predict(clashing(frame(spark, new)), model, keep=[F.lit(True).alias("held_out")]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in new if lang)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(df.limit(0), model).count() == 0
    assert language.fit(df.limit(0), F.lit(True)) is None
    assert language.predict(frame(spark, new[:2]), None).first().lang_pred == "und"


def test_lookup_finds_all_and_only_its_keys():
    import numpy as np

    rnd = np.random.default_rng(2)
    keys = np.unique(rnd.integers(0, 2**32, 5_000, np.uint32))
    other = np.setdiff1d(rnd.integers(0, 2**32, 5_000).astype(np.uint32), keys)
    find = language.Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all() and (find(other) == -1).all()
    assert (language.Lookup(np.empty(0, np.uint32))(other) == -1).all()
