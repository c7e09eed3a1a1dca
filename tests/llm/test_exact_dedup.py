import hashlib

import pytest

from tests.llm.util import clashing, docs, frame, low
from tidemark.llm.exact_dedup import exact_dedup, keep_one


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)])) for i, t in rows}


TEXTS = ["Same text", "sAME TEXT", "same text", "É", "é", None, "", "a" * 70 + "x", "a" * 70 + "y", "a" * 70 + "X", "long " * 40_000, "LONG " * 40_000,
         "ab", "ba", *["hot group"] * 30]


@pytest.mark.parametrize("bits", [23, 4])
def test_equals_brute_force(spark, bits):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, TEXTS), bits=bits).collect()}
    assert got == brute(list(enumerate(TEXTS)))


def test_whole_hash_only_where_needed(spark):
    got = {r.doc_id: r.full_hash for r in exact_dedup(docs(spark, TEXTS)).collect()}
    assert got[0] == hashlib.sha256(b"same text").hexdigest()
    assert got[12] is None or got[13] is None or TEXTS[12][:64] != TEXTS[13][:64]
    assert got[12] is None and got[13] is None  # the same length, other prefixes
    assert got[7] is not None and got[8] is not None  # the same length and prefix: only the whole text tells


def test_columns_and_empty(spark):
    df = clashing(docs(spark, TEXTS))
    assert keep_one(df).columns == df.columns
    assert exact_dedup(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in keep_one(df).collect()) == sorted(i for i, v in brute(list(enumerate(TEXTS))).items() if v[2])


def test_null_and_repeated_ids(spark):
    df = frame(spark, [(None, "a", None, None, None), (None, "only", None, None, None), (1, "a", None, None, None), (2, "b", None, None, None), (2, "b", None, None, None)])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, 1, 2, False), (None, None, 1, True), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, True)], key=str)
    assert keep_one(df).where("text = 'only'").count() == 1


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(2, "b", None, None, None)] * 3 + [(None, "n", None, None, None)] * 2 + [(5, "c", None, None, None), (5, "D", None, None, None), (9, "d", None, None, None)]
    assert sorted((str(r.doc_id), r.text) for r in keep_one(frame(spark, rows)).collect()) == [
        ("2", "b"), ("5", "c"), ("9", "d"), ("None", "n"), ("None", "n")]
