"""Exact top-k by inner product: bounds from a pivot table, candidates in the order of their bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import ship
from tidemark.session import cut

#: Vectors whose distances to all others make the pivot table, and rows that they are chosen from (those with the smallest hash of the id).
PIVOTS, PIVOT_SAMPLE = 48, 1_024
#: Queries of a block, and rows of a block: the task for a pair of blocks holds both.
QUERY_BLOCK, ROW_BLOCK = 2_048, 8_192
#: Candidates that are scored between two looks at the bound.
STEP = 256
SCALE = 1024


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component; null for null vectors and those with a null or non-finite component."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the one that lies furthest from the space of those before: independent, so that distances to them place a vector."""
    rest, chosen = sample.astype(float).copy(), []
    floor = 1e-3 * np.sqrt((sample ** 2).sum(1).max(initial=0.0))
    while len(chosen) < n and len(rest):
        norms = np.sqrt((rest ** 2).sum(1))
        i = int(norms.argmax())
        if norms[i] <= floor:
            break
        chosen.append(i)
        unit = rest[i] / norms[i]
        rest -= np.outer(rest @ unit, unit)
    return sample[chosen].astype(float)


def _placed(table: np.ndarray, squares: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From distances to the pivots: coordinates in their space, and the length of what lies outside of it (from above)."""
    if not len(pivots):
        return np.zeros((len(table), 0)), np.sqrt(squares)
    inner = (squares[:, None] + (pivots ** 2).sum(1) - table ** 2) / 2
    at = np.linalg.solve(np.linalg.cholesky(pivots @ pivots.T), inner.T).T
    return at, np.sqrt(np.maximum(squares - (at ** 2).sum(1), 0.0) + 1e-9 * squares)


def _search(queries: np.ndarray, query_ids: np.ndarray, query_table: np.ndarray, rows: np.ndarray, ids: np.ndarray, table: np.ndarray,
            pivots: np.ndarray, k: int, scored: list[int] | None = None):
    """Best k of the block per query: (query, id, score), each as exact integers in doubles; ``scored`` counts the products worked out.

    Distances to the pivots place each vector in the pivots' space and leave it a rest outside. d(q, x)^2 is at least the squared
    distance there plus that of the lengths of the rests - no single pivot's |d(q, p) - d(x, p)| is larger -, which bounds
    the product from above. Rows are scored from the highest bound down, until the k-th score exceeds the next bound.
    """
    q2, x2 = (queries ** 2).sum(1), (rows ** 2).sum(1)
    at_q, rest_q = _placed(query_table, q2, pivots)
    at_x, rest_x = _placed(table, x2, pivots)
    slack = 1.0 + 1e-7 * np.sqrt(x2.max(initial=0.0))
    for i, q in enumerate(queries):
        bound = at_x @ at_q[i] + rest_x * rest_q[i] + slack * (1.0 + 1e-7 * np.sqrt(q2[i]))
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for at in range(0, len(order), STEP):
            if len(best) >= k and -best[k - 1][0] > bound[order[at]]:
                break
            part = order[at:at + STEP]
            scores = rows[part] @ q
            if scored is not None:
                scored[0] += len(part)
            if len(best) >= k:  # equal scores may win by a smaller id
                good = scores >= -best[k - 1][0]
                part, scores = part[good], scores[good]
            best += [(-s, x) for s, x in zip(scores.tolist(), ids[part].tolist()) if x != query_ids[i]]
            best.sort()
            del best[k:]
        for s, x in best:
            yield int(query_ids[i]), x, int(-s)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Per query its ``k`` highest inner products with all other rows: query_id, rank, vec_id, score; ties go to the smaller id.

    Components count as floor(1024 x). Vectors that are null, or hold null or non-finite components, take no part, nor do
    rows with a null id; vectors are compared with those of their own length, empty ones with none. A row with the query's own id is
    no candidate. Rows that repeat an id are candidates each.

    Queries and rows are dealt into blocks of about a fixed size by hash; a task holds one block of each, with their distances to
    the pivots - a table written once -, and gives at most k rows per query, which a window merges. Every row block meets every query
    block, once; no pair of rows leaves a task.
    """
    dims = F.size("__v")
    base = vectors.select(F.col(id_col).cast("long").alias("__id"), quantised(F.col(vector_col)).alias("__v"), is_query.alias("__q")).where(
        F.col("__id").isNotNull() & F.col("__v").isNotNull() & (dims > 0))
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__q").cast("long")).alias("q")).first()
    row_blocks = -(-max(counts.n, 1) // row_block)
    query_blocks = -(-max(counts.q or 0, 1) // query_block)
    sample = base.orderBy(F.xxhash64("__id"), "__id").select("__v").limit(PIVOT_SAMPLE).collect()
    sizes = sorted({len(r[0]) for r in sample})
    chosen = {d: far_apart(np.array([r[0] for r in sample if len(r[0]) == d], float), pivots) for d in sizes}

    def distances(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = v.values.to_numpy().astype(float)
                own = chosen.get(len(x))
                out.append(np.sqrt(((own - x) ** 2).sum(1)) if own is not None else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=["__id", "__v", "__q", "__t"])

    base = cut(base.mapInArrow(distances, "__id long, __v array<long>, __q boolean, __t array<double>"), "pivots")
    block = lambda n: F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = base.where("__q").select(dims.alias("dims"), block(query_blocks).alias("qb"), every(row_blocks).alias("rb"),
                                       F.lit(True).alias("q"), F.col("__id").alias("id"), F.col("__v").alias("v"), F.col("__t").alias("t"))
    rows = base.select(dims.alias("dims"), every(query_blocks).alias("qb"), block(row_blocks).alias("rb"),
                       F.lit(False).alias("q"), F.col("__id").alias("id"), F.col("__v").alias("v"), F.col("__t").alias("t"))

    def search(batches):
        key, ids, vecs, tables = None, {True: [], False: []}, {True: [], False: []}, {True: [], False: []}

        def done():
            if ids[True] and ids[False]:
                x, q = (np.concatenate(vecs[s]).astype(float).reshape(len(ids[s]), -1) for s in (False, True))
                table, q_table = (np.concatenate(tables[s]).reshape(len(ids[s]), -1) for s in (False, True))
                own = chosen.get(x.shape[1], np.empty((0, x.shape[1])))
                got = list(_search(q, np.array(ids[True]), q_table, x, np.array(ids[False]), table, own, k))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["query_id", "vec_id", "score"])

        for b in batches:
            flat, far = b.column(5).flatten().to_numpy(), b.column(6).flatten().to_numpy()
            at = far_at = 0
            for d, qb, rb, q, i, n in zip(*(b.column(c).to_pylist() for c in range(5)), b.column(6).value_lengths().to_pylist()):
                if (d, qb, rb) != key:
                    yield from done()
                    key, ids, vecs, tables = (d, qb, rb), {True: [], False: []}, {True: [], False: []}, {True: [], False: []}
                ids[q].append(i)
                vecs[q].append(flat[at:at + d])
                tables[q].append(far[far_at:far_at + n])
                at, far_at = at + d, far_at + n
        yield from done()

    found = (queries.unionByName(rows).repartition("dims", "qb", "rb").sortWithinPartitions("dims", "qb", "rb")
             .mapInArrow(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship(__name__)
