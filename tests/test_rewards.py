"""Reward shaping against a sequential fold, decisions against hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import decide as D
from tidemark.operators import rewards as R

KINDS = ["fill_missing", "remove_duplicate", "remove_outlier", "fix_category", "fix_type", "fix_formatting", "skip", "skip", "skip", "dance"]
ISSUES = ["missing:age", "duplicate:row", "outlier:salary", "category:dept", "formatting:email", "wrong_type:score"]


def fold(rows, total):
    """The rules, one decision after another."""
    history, out = [], []
    words = {"fill_missing": (["missing:"], 0.1), "remove_duplicate": (["duplicate"], 0.1), "remove_outlier": (["outlier"], 0.1),
             "fix_category": (["category", "formatting"], 0.05), "fix_type": (["type"], 0.05)}
    for step, (kind, col, issues) in enumerate(rows, 1):
        base = vocab.BASE_REWARDS.get(kind, 0.0)
        progress = int(step / total * 5) * 0.05
        same = [r for k, _, r in history[-100:] if k == kind]
        share = sum(r > 0 for r in same) / len(same) if same else 0.0
        steady = 0.1 if share >= 0.8 else 0.05 if share >= 0.6 else 0.0
        clash = -0.2 if any(c == col and k != kind and k != "skip" for k, c, _ in history[-5:]) else 0.0
        parts, each = words.get(kind, ([], 0.0))
        fits = sum(any(p in i for p in parts) for i in issues) * each
        major = any(i.startswith(p) for i in issues for p in ("missing:", "duplicate", "outlier"))
        bonus = 0.1 if kind == "skip" and not major else 0.0
        total_reward = max(-1.0, min(1.0, base + progress + steady + clash + fits + bonus))
        history.append((kind, col, total_reward))
        out.append(total_reward)
    return out


def episode(seed, n, kinds):
    rnd = random.Random(seed)
    return [(rnd.choice(kinds), rnd.choice("ab"), [i for i in ISSUES if rnd.random() < 0.15]) for _ in range(n)]


@pytest.mark.parametrize("width", [100, 137, 100_000])
def test_shaped_reward_equals_the_fold(spark, width):
    episodes = {0: episode(1, 900, KINDS), 1: episode(2, 60, KINDS), 2: episode(3, 1200, ["skip"]), 3: episode(4, 500, ["skip", "dance"])}
    data = [(e, s, k, c, i) for e, rows in episodes.items() for s, (k, c, i) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "episode long, step long, action_type string, column string, issues array<string>")
    got = {(r.episode, r.step): r.reward for r in R.shaped_reward(df, width=width).collect()}
    assert len(got) == len(data)
    for e, rows in episodes.items():
        for s, want in enumerate(fold(rows, len(rows)), 1):
            assert got[e, s] == pytest.approx(want, abs=1e-9), (e, s)


def decide(spark, issues, legal=None, similarity=None, history=None, **row):
    full = {"id": 1, "name": "zed", "age": 30, "salary": 60000, "dept": "sales", "email": "zed@x.org", **row}
    schema = "id long, name string, age long, salary long, dept string, email string, issues array<string>"
    df = spark.createDataFrame([(*full.values(), issues)], schema)
    lit = None if legal is None else F.array(*[F.lit(x) for x in legal])
    sim = None if similarity is None else F.lit(similarity)
    c = D.recommend(df, D.default_specialists(df, F.col("issues"), lit, similarity=sim))
    hist = None if history is None else spark.createDataFrame(history, "agent string, reward_avg double")
    return D.choose_action(c, history=hist).first().decision


def test_choices(spark):
    d = decide(spark, ["missing:age"], age=None)
    assert (d.agent, d.action_type, d.column, d.value) == ("FillMissingAgent", "fill_missing", "age", "30")
    assert d.score == pytest.approx(0.4 * 0.8 + 0.3 * 0.5 + 0.3 * 0.5)
    d = decide(spark, ["outlier:age"], age=150)
    assert (d.agent, d.value, d.confidence) == ("OutlierHandler", "35", 0.9)
    d = decide(spark, ["outlier:salary"], salary=900000)
    assert (d.column, d.value) == ("salary", "75000")
    d = decide(spark, ["category:dept"], dept="enginering")
    assert (d.action_type, d.value) == ("fix_category", "engineering") and d.confidence == pytest.approx(0.9524, abs=1e-4)
    assert decide(spark, ["duplicate:row"], similarity=0.8).action_type == "remove_duplicate"
    assert decide(spark, ["duplicate:row"], similarity=0.6).agent == "SkipAgent"
    assert decide(spark, []).score == pytest.approx(0.23)
    assert decide(spark, ["missing:age"], legal=["skip"], age=None).agent == "SkipAgent"
    assert decide(spark, ["missing:planet"]).agent == "SkipAgent"
    with pytest.raises(ValueError):
        D.specialist("Nobody", None, None)


def test_history_changes_the_choice(spark):
    issues = ["missing:age", "outlier:salary"]
    assert decide(spark, issues, age=None, salary=900000).agent == "OutlierHandler"
    d = decide(spark, issues, age=None, salary=900000, history=[("OutlierHandler", -0.5), ("FillMissingAgent", 0.4)])
    assert d.agent == "FillMissingAgent"


def test_argmax(spark):
    df = spark.createDataFrame([([1.0, 9.0, 3.0, 0.0, 0.0, 0.0, 20.0], ["skip", "remove_duplicate"]), ([1.0] * 7, [])], "q array<double>, legal array<string>")
    got = [tuple(r.x) for r in df.select(D.masked_argmax(F.col("q"), F.col("legal")).alias("x")).collect()]
    assert got == [("remove_duplicate", 1.0), ("skip", 0.0)]
