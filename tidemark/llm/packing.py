"""Packing token pieces into sequences under several limits: vector bin packing by dot products."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ship
from tidemark.llm.tokens import encoder

TOKENS, SEGMENTS = 1024, 64
#: Pieces that wait for a place at a time; a task never holds more.
POOL = 2_048

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long")


class Packer:
    """Places pieces into one open sequence after the other.

    A piece's demand is (tokens, 1 segment, loss-bearing tokens), a sequence's room what its limits leave. Of the
    waiting pieces that fit, the one whose demand has the largest dot product with the room, both as shares of
    the limits, comes next. Where none fits whole, or the last segment is up, one that is long enough is cut to fill the
    sequence to its last token. ``emit(owner, start, length, sequence, offset, loss)`` gets each piece placed.
    """

    def __init__(self, emit, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, keep=None):
        """``keep(owner, start)``, if given, is what waits in an owner's place: it needs its tokens from ``start`` on only."""
        self.emit, self.limits, self.pool, self.keep = emit, np.array([tokens, segments, loss or tokens], float), pool, keep
        self.owner: list = []
        self.starts = np.zeros(pool + 64, np.int64)
        self.size = np.zeros(pool + 64, np.int64)
        self.free = np.zeros(pool + 64, np.int64)  # leading tokens of a piece that bear no loss
        self.owner = [None] * (pool + 64)
        self.n = 0
        self.sequence = 0

    def add(self, owner, start: int, size: int, free: int = 0) -> None:
        """A document's tokens from ``start`` on; the first ``free`` of them bear no loss."""
        tokens, _, loss = (int(x) for x in self.limits)
        while size:
            take = min(size, tokens, free + loss if free < size else size)
            if take == tokens:
                self._put([(owner, start, take, max(0, take - free))])
            else:
                i = self.n
                if self.keep and size == take:
                    owner = self.keep(owner, start)
                self.owner[i], self.starts[i], self.size[i], self.free[i] = owner, start, take, min(free, take)
                self.n += 1
                if self.n >= self.pool:
                    self._fill()
            start, size, free = start + take, size - take, max(0, free - take)

    def finish(self) -> None:
        while self.n:
            self._fill(last=True)

    def _put(self, pieces) -> None:
        at = 0
        for owner, start, length, loss in pieces:
            self.emit(owner, start, length, self.sequence, at, loss)
            at += length
        self.sequence += 1

    def _take(self, i: int, length: int):
        """The first tokens of a waiting piece; what is left of it waits on."""
        piece = (self.owner[i], int(self.starts[i]), length, max(0, length - int(self.free[i])))
        if length < self.size[i]:
            self.starts[i] += length
            self.size[i] -= length
            self.free[i] = max(0, self.free[i] - length)
        else:
            j = self.n = self.n - 1
            self.owner[i], self.starts[i], self.size[i], self.free[i] = self.owner[j], self.starts[j], self.size[j], self.free[j]
            self.owner[j] = None
        return piece

    def _fill(self, last: bool = False) -> None:
        """Close sequences until half the pool is free, or one of them at the end."""
        least = 0 if last else self.pool // 2
        while self.n > least:
            pieces, room = [], self.limits.copy()
            if last and int(self.size[:self.n].sum()) < room[0]:
                # the rest: a sequence as long as a power of two needs no padding
                room[0] = 1 << (int(self.size[:self.n].sum()).bit_length() - 1)
            while self.n and room.min() >= 1:
                size, loss = self.size[:self.n], self.size[:self.n] - self.free[:self.n]
                if room[1] == 1:
                    fits = np.zeros(self.n, bool)
                    exact = (size == room[0]) & (loss <= room[2])
                    fits = exact if exact.any() else fits
                else:
                    fits = (size <= room[0]) & (loss <= room[2])
                if fits.any():
                    a = room / self.limits / self.limits
                    score = np.where(fits, size * a[0] + a[1] + loss * a[2], -1.0)
                    i = int(score.argmax())
                    got = int(size[i])
                else:
                    most = np.minimum(size, np.minimum(room[0], self.free[:self.n] + room[2]))
                    i = int(most.argmax())
                    got = int(most[i])
                piece = self._take(i, got)
                pieces.append(piece)
                room -= (piece[2], 1, piece[3])
            self._put(pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt_tokens: Column | None = None) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A sequence holds at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens (default: as many
    as tokens); the first ``prompt_tokens`` of a document bear none (null: 0). ``end_id`` follows each document; a null text
    counts as empty and is that id alone. Each task packs the documents it reads, with a bounded pool, so nothing is
    shuffled, no group gathers anywhere, and a task run again gives the same pieces. Sequence ids are the task's number times
    2**40 plus a count. Repeated rows are packed each by itself; an empty table gives no pieces.
    """
    free = F.lit(0) if prompt_tokens is None else F.greatest(F.coalesce(prompt_tokens, F.lit(0)), F.lit(0))

    def run(batches):
        from pyspark import TaskContext

        base, enc, end = TaskContext.get().partitionId() << 40, encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        out: list[tuple] = []

        def emit(owner, start, length, sequence, offset, bears):
            name, total, begin, ids = owner
            out.append((name, start, length, zlib.crc32(ids[4 * (start - begin):4 * (start - begin + length)]), total, base + sequence, offset, bears))

        def rest(owner, start):
            name, total, begin, ids = owner
            return name, total, start, ids[4 * (start - begin):]

        def rows():
            cols = list(zip(*out))
            out.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        packer = Packer(emit, tokens, segments, loss, keep=rest)
        for batch in batches:
            for name, text, prompt in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = enc.encode(text.as_py()) + end
                packer.add((name.as_py(), len(ids) // 4, 0, ids), 0, len(ids) // 4, min(prompt.as_py(), len(ids) // 4))
                if len(out) >= 4096:
                    yield rows()
        packer.finish()
        if out:
            yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       free.cast("int").alias("free")).mapInArrow(run, PIECES)


ship(__name__)
