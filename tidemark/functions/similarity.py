"""Longest-matching-blocks ratio and its lossless native bounds.

``ratio(a, b) = 2 M / (|a| + |b|)`` where M counts the characters of the recursively longest
matching blocks. It depends on the order of the arguments and has no built-in counterpart, so it is
the one piece of row-wise Python, fed in Arrow batches and only with pairs that pass the bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql import types as T


#: Pairs of texts that a ratio function remembers.
REMEMBERED = 100_000


def matcher() -> Callable[[], Callable[[str, str], float]]:
    """Gives a maker of ratio functions that remember what they have seen.

    The maker is a local function, so it travels to the tasks by value and nothing of this package has to
    be installed there.
    """
    most = REMEMBERED

    def make() -> Callable[[str, str], float]:
        seen: dict[tuple[str, str], float] = {}

        def ratio(a: str, b: str) -> float:
            if a == b:
                return 1.0
            found = seen.get((a, b))
            if found is None:
                if len(seen) >= most:
                    seen.clear()
                found = seen[a, b] = SequenceMatcher(None, a, b).ratio()
            return found

        return ratio

    return make


#: Longest text, and how many pairs at once, that :func:`batch_matcher` compares in arrays.
IN_ARRAYS, LANES = 64, 2_048


def batch_matcher():
    """Gives a maker of functions that work out the ratios of many pairs at once.

    Texts are places in one array of characters' codes, of bytes below 254 or of 64 bits: ``starts`` and ``sizes`` of both sides. The longest
    stretches of many pairs are found by one table of run lengths, then those to their left and right, until nothing is in common;
    texts of over ``IN_ARRAYS`` characters go one by one.
    """
    make, longest, lanes = matcher(), IN_ARRAYS, LANES

    def maker():
        one, room = make(), np.empty((longest + 1) ** 2 * lanes, np.uint8)

        def windows(chars, start, size, pad):
            at = np.arange(size.max(), dtype=start.dtype)[:, None]
            found = chars[np.minimum(start + at, len(chars) - 1)]
            found[at >= size] = pad
            return found

        def stretch(chars, a, la, b, lb):
            """The longest common stretch of each pair, the first in a, then in b: its length and where it ends."""
            pads = (254, 255) if chars.dtype == np.uint8 else (1 << 30, 1 << 31)
            x, y = windows(chars, a, la, pads[0]), windows(chars, b, lb, pads[1])
            shape = len(x) + 1, len(y) + 1, len(a)
            runs = room[:shape[0] * shape[1] * shape[2]].reshape(shape)
            runs[0], runs[:, 0] = 0, 0
            best, i = np.zeros(len(a), np.uint8), np.zeros(len(a), a.dtype)
            for n in range(len(x)):
                np.add(runs[n, :-1], 1, out=runs[n + 1, 1:])
                runs[n + 1, 1:] *= x[n] == y
                most = runs[n + 1].max(axis=0)
                i[most > best] = n + 1
                np.maximum(best, most, out=best)
            j = (runs[i, :, np.arange(len(a))] == best[:, None]).argmax(axis=1)
            return best.astype(a.dtype), i, j.astype(a.dtype)

        def ratios(chars, a, la, b, lb):
            total, short = np.zeros(len(a), np.int64), np.maximum(la, lb) <= longest
            work = np.stack([np.arange(len(a)), a, la, b, lb])[:, short & (la > 0) & (lb > 0)]
            if len(chars) < 1 << 30:
                work = work.astype(np.int32)
            while work.shape[1]:
                rest, sizes, kind = [], [], np.ceil(np.log2(np.maximum(work[2], work[4]))).astype(np.int8)
                for k in np.unique(kind):  # windows of like sizes together
                    some = work[:, kind == k]
                    for n in range(0, some.shape[1], lanes):
                        of, a_, la_, b_, lb_ = some[:, n:n + lanes]
                        size, i, j = stretch(chars, a_, la_, b_, lb_)
                        sizes.append(np.stack([of, size]))
                        left = (i > size) & (j > size) & (size > 0)
                        right = (la_ > i) & (lb_ > j) & (size > 0)
                        rest.append(np.stack([x[left] for x in (of, a_, i - size, b_, j - size)]))
                        rest.append(np.stack([x[right] for x in (of, a_ + i, la_ - i, b_ + j, lb_ - j)]))
                work, (of, size) = np.concatenate(rest, axis=1), np.concatenate(sizes, axis=1)
                total += np.bincount(of, size, len(total)).astype(np.int64)
            out = np.where(la + lb == 0, 1.0, 2.0 * total / np.maximum(la + lb, 1))
            for n in np.nonzero(~short)[0]:
                out[n] = one(*("".join(map(chr, chars[s:s + l].tolist())) for s, l in ((a[n], la[n]), (b[n], lb[n]))))
            return out

        return ratios

    return maker


def ratio_udf(lower_first: bool = False):
    """Arrow-batched UDF over two text columns (the first in lower case if asked for)."""
    make = matcher()

    @F.pandas_udf(T.DoubleType())
    def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        ratio = make()
        return pd.Series(
            [None if x is None or y is None else ratio(x.lower() if lower_first else x, y) for x, y in zip(a, b)],
            dtype="float64",
        )

    return ratcliff_ratio


def register(spark: SparkSession) -> None:
    """Make ``ratcliff_ratio(a, b)`` callable from SQL."""
    spark.udf.register("ratcliff_ratio", ratio_udf())


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


def edit_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the edit distance: matching blocks are a common subsequence,
    so distance <= |a| + |b| - 2M."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / total)


def within_edits(a: Column, b: Column, threshold: float) -> Column:
    """``edit_bound(a, b) >= threshold``, with the distance computed only as far as it matters."""
    allowed = F.floor((1.0 - threshold + 1e-9) * (F.length(a) + F.length(b))).cast("int")
    return F.call_function("levenshtein", a, b, allowed) >= 0


def char_tokens(c: Column) -> Column:
    """Each character with its running number among equal characters, late repeats first.

    Two strings share exactly as many tokens as their character bags overlap, which bounds M. Any
    fixed order is right for prefix filtering; late repeats are the rarer tokens.
    """
    def numbered(x: Column, i: Column) -> Column:
        so_far = F.substring(c, F.lit(1), i + 1)
        nth = F.length(so_far) - F.length(F.replace(so_far, x, F.lit("")))
        return F.struct((-nth).alias("nth"), x.alias("ch"))

    return F.array_sort(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), numbered))


def prefix_tokens(c: Column, threshold: float) -> Column:
    """The tokens of which a partner with ratio >= threshold must share at least one.

    A partner shares at least ``t/2 (|a|+|b|)`` tokens and has ``|b| >= t/(2-t) |a|``, hence at least
    ``t/(2-t) |a|``; so two such strings meet within the first ``|a| - that + 1`` tokens.
    """
    share = threshold / (2.0 - threshold)
    keep = F.length(c) - F.ceil(F.length(c) * share - 1e-9).cast("int") + 1
    tokens = F.transform(
        F.slice(char_tokens(c), 1, F.greatest(keep, F.lit(1))),
        lambda t: F.concat(t["ch"], (-t["nth"]).cast("string")),
    )
    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(tokens)
