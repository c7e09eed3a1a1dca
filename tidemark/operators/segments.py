"""Ordered computations over groups of any size.

A plain window sends a whole group to one task. So the groups are counted first - partial sums, one small row per group and
task - and only a group of over ``width`` rows is cut into pieces, so that one key holding a third of the table is
spread over many tasks. All others, mostly the whole table, go through one plain window:

* :func:`with_rank` - positions; of a heavy group from per-piece counts and a small prefix sum over pieces;
* :func:`with_running` - running totals, the same way;
* :func:`over_rows` - any frame that looks a bounded number of rows back or ahead; in a heavy group the
  rows next to a piece's edge are shown to its neighbour as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.session import cut

DEFAULT_WIDTH = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join where NULL keys match each other; the right side's keys are dropped."""
    tmp = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(tmp)
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[tmp[k]])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*tmp.values())


def heavy_groups(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame | None:
    """The keys of over ``width`` rows, written; None if there is none. A table has at most one per ``width`` rows."""
    found = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > width), "heavy")
    return None if found.isEmpty() else found.drop("__n")


def apart(df: DataFrame, keys: Sequence[str], width: int, plain: Callable[[DataFrame], DataFrame],
          pieced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` for the groups of up to ``width`` rows, ``pieced`` for the others; both add the same columns."""
    heavy = heavy_groups(df, keys, width)
    if heavy is None:
        return plain(df)
    if not keys:
        return pieced(df)
    return plain(null_safe(df, heavy, keys, "left_anti")).unionByName(pieced(null_safe(df, heavy, keys, "left_semi")))


def _with_starts(df: DataFrame, keys: Sequence[str], order: str, width: int, measures: dict[str, Column]) -> DataFrame:
    """Add ``__piece`` (by the order column) and, per measure, the total of the earlier pieces."""
    pieces = df.withColumn("__piece", F.floor(F.col(order) / width))
    totals = pieces.groupBy(*keys, "__piece").agg(*[m.alias(f"__t_{n}") for n, m in measures.items()])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in measures]
    )
    return null_safe(pieces, starts, [*keys, "__piece"], "inner")


def with_rank(df: DataFrame, keys: Sequence[str], order: str, width: int = DEFAULT_WIDTH, name: str = "rank") -> DataFrame:
    """1-based position by ``order`` (unique integers) within each group.

    Of a heavy group a task sorts the rows whose order values fall in one stretch of ``width``.
    """
    def plain(d: DataFrame) -> DataFrame:
        return d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))

    return apart(df, keys, width, plain, lambda d: _ranked_pieces(d, keys, order, width, name))


def _ranked_pieces(df: DataFrame, keys: Sequence[str], order: str, width: int, name: str) -> DataFrame:
    local = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(order))
    out = _with_starts(df, keys, order, width, {"n": F.count(F.lit(1))})
    return out.withColumn(name, (local + F.col("__s_n")).cast("bigint")).drop("__piece", "__s_n")


def with_running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column],
                 width: int = DEFAULT_WIDTH) -> DataFrame:
    """Running totals (current row included) of the given columns by ``order``."""
    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})

    def pieced(d: DataFrame) -> DataFrame:
        out = _with_starts(d, keys, order, width, {n: F.sum(c) for n, c in sums.items()})
        w = Window.partitionBy(*keys, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__s_{n}") for n, c in sums.items()})
        return out.drop("__piece", *[f"__s_{n}" for n in sums])

    return apart(df, keys, width, plain, pieced)


def spread(df: DataFrame, rank: str, back: int, ahead: int, width: int) -> DataFrame:
    """Add ``__piece`` and ``__guest``: every row in its own piece, edge rows also in the neighbour's."""
    pos = F.col(rank) - 1
    piece = F.floor(pos / width)
    shown = [F.struct(piece.alias("piece"), F.lit(False).alias("guest"))]
    if back:
        shown.append(F.when(pos % width >= width - back, F.struct((piece + 1).alias("piece"), F.lit(True).alias("guest"))))
    if ahead:
        shown.append(F.when((pos % width < ahead) & (piece > 0),
                            F.struct((piece - 1).alias("piece"), F.lit(True).alias("guest"))))
    if len(shown) > 1:
        cut = df.withColumn("__p", F.explode(F.array(*shown))).filter(F.col("__p").isNotNull())
    else:
        cut = df.withColumn("__p", shown[0])
    cut = cut.withColumns({"__piece": F.col("__p.piece"), "__guest": F.col("__p.guest")}).drop("__p")
    return cut


def over_pieces(df: DataFrame, keys: Sequence[str], rank: str, exprs: dict[str, Callable[[WindowSpec], Column]],
                back: int = 0, ahead: int = 0, width: int = DEFAULT_WIDTH, also: Sequence[str] = ()) -> DataFrame:
    """Window expressions that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``rank`` is the dense 1-based position in the group. Each expression gets the window
    (partitioned and ordered, no frame set) and returns a Column. ``also`` narrows the window to
    rows that agree in further columns; range frames then still count in positions of the group.
    """
    if max(back, ahead) > width:
        raise ValueError("width must not be below the frame")
    cut = spread(df, rank, back, ahead, width)
    w = Window.partitionBy(*keys, "__piece", *also).orderBy(rank)
    out = cut.withColumns({n: f(w) for n, f in exprs.items()})
    return out.filter(~F.col("__guest")).drop("__piece", "__guest")


def over_rows(df: DataFrame, keys: Sequence[str], order: str, exprs: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0,
              width: int = DEFAULT_WIDTH, also: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """:func:`over_pieces` for heavy groups, one plain window for all others.

    ``order`` are unique integers; with ``rank`` the expressions may use that name for the 1-based position, otherwise ``order``
    is itself dense, from 1.
    """
    if max(back, ahead) > width:
        raise ValueError("width must not be below the frame")

    def plain(d: DataFrame) -> DataFrame:
        if rank:
            d = d.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))
        w = Window.partitionBy(*keys, *also).orderBy(rank or order)
        return d.withColumns({n: f(w) for n, f in exprs.items()})

    def pieced(d: DataFrame) -> DataFrame:
        return over_pieces(_ranked_pieces(d, keys, order, width, rank) if rank else d, keys, rank or order, exprs, back, ahead, width, also)

    out = apart(df, keys, width, plain, pieced)
    return out.drop(rank) if rank else out
