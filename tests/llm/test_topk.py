import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import clashing
from tidemark.llm.topk import top_k


def brute(rows, is_query, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def rows(n=700, dims=12, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = [(i, [c + rnd.gauss(0, 0.3) for c in centres[i % 6]]) for i in range(n)]
    out += [(n + i, [0.5] * dims) for i in range(40)]  # ties
    return out + [(5000, None), (5001, [None] + [1.0] * (dims - 1)), (5010, [float("nan")] * dims), (5020, [float("inf")] * dims), (5030, []), (5040, [1.0, 2.0]), (5050, [3.0, -4.0]), (None, [1.0] * dims)]


@pytest.mark.parametrize("blocks", [(2_048, 8_192), (7, 50)])
@pytest.mark.parametrize("pivots", [48, 3, 0])
def test_equals_brute_force(spark, blocks, pivots):
    df = clashing(spark.createDataFrame(rows(), "vec_id long, embedding array<double>").repartition(3))
    got = top_k(df, F.col("vec_id") % 10 == 0, 10, pivots=pivots, query_block=blocks[0], row_block=blocks[1])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows(), lambda i: i % 10 == 0, 10)


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(df.limit(0), F.lit(True)).count() == 0 and top_k(df, F.lit(False)).count() == 0
    same = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in top_k(same, F.col("vec_id") == 0).collect()] == [1, 1]


def test_bounds_leave_most_rows_unscored(spark):
    """On the given vectors fewer than half of the products are worked out, and the result is that of all."""
    from tidemark.llm import topk as T

    found = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in found], float))
    pivots = T.far_apart(x[:T.PIVOT_SAMPLE], T.PIVOTS)
    table = np.sqrt(((x[:, None] - pivots) ** 2).sum(2))
    queries = np.arange(0, len(x), 100)
    scored = [0]
    got = list(T._search(x[queries], queries, table[queries], x, np.arange(len(x)), table, pivots, 10, scored))
    share = scored[0] / (len(x) * len(queries))
    print(f"{share:.2f} of the products worked out")
    assert share < 0.5
    for i in queries:
        scores = x @ x[i]
        want = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != i)[:10]
        assert [(j, s) for q, j, s in got if q == i] == [(j, int(-s)) for s, j in want]
