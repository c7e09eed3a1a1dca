"""Alignment of two tokenizers' tokens by the byte offsets at which both end one.

The two lists of ends are intersected by galloping: the shorter one drives an exponential and then a binary search in the longer.
The common ends' places in both lists cut them into groups, and the differences of places give each group's ranges.

A byte-level BPE (A) and a sentencepiece BPE (B) both begin anew at a blank between two words, and mostly between a word and the
punctuation after it, so texts are cut there and the groups of a piece are kept: most pieces repeat.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ship, worker_store
from tidemark.session import cut

#: Pieces that a worker remembers.
KEEP = 400_000
#: B's sign for a blank.
SPACE = "▁"
#: Links are one number: A's id times this, plus B's.
SHIFT = 1 << 32


def common_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """(i, j) of all a[i] == b[j] in two strictly rising lists."""
    if len(b) < len(a):
        return [(i, j) for j, i in common_ends(b, a)]
    out, at, n = [], 0, len(b)
    for i, x in enumerate(a):
        step = 1
        while at + step < n and b[at + step] < x:
            step += step
        at = bisect_left(b, x, at + step // 2, min(n, at + step + 1))
        if at == n:
            break
        if b[at] == x:
            out.append((i, at))
    return out


class Aligner:
    """Both tokenizers, and what is known of pieces."""

    def __init__(self, a_path: str, b_path: str, keep: int = KEEP):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.shown = _byte_level(self.a)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.len_a, self.len_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        # what stands side by side in a piece of B may be tied together; a blank must not
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.tied = {n[i:i + 2] for n in names for i in range(len(n) - 1)}
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.keep, self.known = keep, {}

    def pieces(self, text: str) -> list[str]:
        """Parts of blank + text, each beginning with a blank, that both tokenizers encode by themselves."""
        if not self.cuts or "  " in text or text[0] == " " or text[-1] == " " or _BESIDE.search(text):
            return [" " + text]
        return [" " + w for w in text.split(" ")]

    def entries(self, pieces: list[str]) -> list[tuple]:
        """Per piece: A's and B's tokens, groups, the groups' text, links; () where the tokens don't give the piece back."""
        known, keep = self.known, self.keep
        out = [known.get(p) for p in pieces]
        if None not in out:
            return out
        fresh: dict[str, tuple | None] = {}
        parts = {}
        for p, e in zip(pieces, out):
            if e is None and p not in parts:
                core = p.rstrip(TAIL)
                tail = p[len(core):]
                # letters and the punctuation behind them are words of their own for A, and for B if no piece ties them
                split = tail and core[1:].isalpha() and core[-1] + tail[0] not in self.tied and "a" + tail[0] not in self.tied
                parts[p] = (core, tail) if split else (p,)
                for x in parts[p]:
                    if x not in known:
                        fresh[x] = None
        if fresh:
            self._learn(fresh)
            for x, e in fresh.items():
                if len(known) < keep and len(x) <= 48:
                    known[x] = e

        def entry(x: str) -> tuple:
            e = fresh.get(x)
            return known[x] if e is None else e

        for p, of in parts.items():
            found = [entry(x) for x in of]
            if len(found) == 1:
                parts[p] = found[0]
            else:
                x, y = found
                parts[p] = (x[0] + y[0], x[1] + y[1], x[2] + y[2], f"{x[3]};{y[3]}", x[4] + y[4]) if x and y else ()
        return [parts[p] if e is None else e for p, e in zip(pieces, out)]

    def _learn(self, fresh: dict) -> None:
        words = list(fresh)
        # a tail begins without a blank: B gets it behind a letter that it isn't tied to
        b = self.b.encode([w[1:] if w[0] == " " else "a" + w for w in words], num_threads=1)
        whole = [w for w in words if w[0] != " " or not w[1:].isalpha()]
        others = dict(zip(whole, self.a.encode_batch(whole, add_special_tokens=False))) if whole else {}
        tokenize = self.a.model.tokenize
        for w, ids in zip(words, b):
            if w in others:
                fresh[w] = self._entry(w, others[w].ids, ids if w[0] == " " else ids[1:])
            else:  # letters behind a blank are one word, whose bytes go to A's model
                fresh[w] = self._entry(w, [t.id for t in tokenize(w.encode().decode("latin-1").translate(self.shown))], ids)

    def _entry(self, piece: str, a: list[int], b: list[int]) -> tuple:
        whole = piece.encode("utf-8", "surrogatepass")
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in a]) != whole or b"".join([bytes_b[i] for i in b]) != whole:
            return ()
        len_a, len_b = self.len_a, self.len_b
        at = common_ends(list(accumulate([len_a[i] for i in a])), list(accumulate([len_b[i] for i in b])))
        groups, i0, j0 = [], 0, 0
        for i, j in at:
            groups.append(f"{a[i] if i == i0 else ','.join(map(str, a[i0:i + 1]))}|{b[j] if j == j0 else ','.join(map(str, b[j0:j + 1]))}")
            i0, j0 = i + 1, j + 1
        return len(a), len(b), len(at), ";".join(groups), array("q", [a[i] * SHIFT + b[j] for i, j in at]).tobytes()


#: A blank between two other white-space characters: the run around it is one for A.
_BESIDE = re.compile(r"[^\S ] [^\S ]")


#: ASCII punctuation but the apostrophe, which may begin a word.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_level(tokenizer) -> tuple[list[bytes], dict[int, str]]:
    """The bytes of every entry, and the sign of every byte: printable Latin-1 characters stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [n.encode() if n in special else bytes(back[c] for c in n) for n in names], {x: c for c, x in back.items()}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two files."""
    store = worker_store("aligners")
    if (a_path, b_path) not in store:
        store.clear()
        store[a_path, b_path] = Aligner(a_path, b_path)
    return store[a_path, b_path]


def groups_of(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups and the row's links (``a``, ``b``, ``times`` of each distinct one).

    ``groups`` is `a1,a2|b1;a3|b2,b3`, the ids in order, or with ``digest`` the hexadecimal SHA-256 of that. Texts that are null or
    empty, or that either tokenizer's tokens don't give back byte for byte behind a blank, have no tokens: zeros and an empty
    string. Special tokens' strings within texts are plain text. Repeated rows and null ids are rows like others.
    """
    def run(batches):
        both = aligner(a_path, b_path)
        for batch in batches:
            counts, groups, links = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                got = both.entries(both.pieces(text)) if text else [()]
                if () in got:
                    counts.append((0, 0, 0, 0))
                    groups.append("")
                    links.append(np.empty((2, 0), np.int64))
                    continue
                n = sum(e[2] for e in got)
                counts.append((sum(e[0] for e in got), sum(e[1] for e in got), n, n))
                joined = ";".join([e[3] for e in got])
                groups.append(hashlib.sha256(joined.encode()).hexdigest() if digest else joined)
                links.append(np.stack(np.unique(np.frombuffer(b"".join([e[4] for e in got]), np.int64), return_counts=True)))
            offsets = pa.array(np.append(0, np.cumsum([x.shape[1] for x in links])).astype(np.int32))
            flat, times = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(groups, pa.string()),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (flat // SHIFT, flat % SHIFT, times)]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each two ids are linked in all rows, and whether no other link of ``b`` is more frequent.

    The shorter token of a link is the end of the longer, so there are at most as many links as the bytes of both
    vocabularies: some hundred thousand, however large the corpus.
    """
    def run(batches):
        for batch in batches:
            a, b, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(3))
            keys, at = np.unique(a * SHIFT + b, return_inverse=True)
            n = np.bincount(at, times, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((keys // SHIFT).astype(np.int32)), pa.array((keys % SHIFT).astype(np.int32)), pa.array(n)],
                                             names=["a", "b", "n"])

    counts = aligned.select("a", "b", "times").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = cut(counts, "links")
    most = counts.groupBy("b").agg(F.max("n").alias("__most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("__most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (see :func:`groups_of`).

    ``n_best`` are the row's links that are the most frequent ones of their B id in all rows, ties included; ``count_sum`` adds up
    the frequencies of its links. The table of links goes to every task; :func:`link_counts` says what bounds it.
    """
    rows = cut(groups_of(docs, a_path, b_path, id_col, text_col, digest), "aligned")
    table = link_counts(rows).toArrow()
    a, b, n, best = (table.column(i).to_numpy() for i in range(4))
    keys = a.astype(np.int64) * SHIFT + b
    order = np.argsort(keys)
    keys, n, best = keys[order], n[order], best[order].astype(np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column(6)
            flat = lists.flatten().to_numpy().astype(np.int64) * SHIFT + batch.column(7).flatten().to_numpy()
            times = batch.column(8).flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, flat)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(n_best, row, best[at] * times)
            np.add.at(count_sum, row, n[at] * times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n_best), pa.array(count_sum), batch.column(5)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


ship(__name__)
