"""Packing token sequences: vector bin packing under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, tidied
from .tokens import encoder

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 1024, 64, 1024
#: Remainders of documents that wait for a place at a time.
POOL = 1024
#: Sequence ids of a task start at its partition's number times this.
STRIDE = 1 << 40
#: The id that ends a document.
END = 0


class Document(NamedTuple):
    """What a waiting segment needs of its document: ids from token `base` on."""

    doc_id: int | None
    ids: bytes
    base: int
    tokens: int

    def tail(self, at: int) -> Document:
        return self._replace(ids=self.ids[4 * (at - self.base) :], base=at)

    def cut(self, at: int, n: int) -> bytes:
        return self.ids[4 * (at - self.base) : 4 * (at - self.base + n)]


class Packer:
    """Places segments of (tokens, loss) sizes into sequences.

    Full stretches of a document that meet the limits alone fill sequences by themselves. What is left waits
    in a pool; from a full pool sequences are opened one by one. Each takes the waiting segment whose demand
    (tokens, one segment, loss, each as a share of its limit) has the largest dot product with what the
    sequence has left, until nothing more fits whole; then the last gap is filled with the head of a waiting
    segment, which may be cut anywhere. Ties: the longer wait. When input ends, the last segments go to
    sequences whose lengths are powers of two, which need no padding."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits start at 1")
        self.limits = np.array([tokens, segments, loss], float)
        self.pool = pool
        #: Waiting segments by slot, in order of arrival; a slot whose segment has been placed is None, of infinite size.
        self.names: list[tuple | None] = []
        self.sizes = np.full((2 * pool, 3), np.inf)
        self.waiting = 0
        self.sequence = 0

    def add(self, document: Document, loss_from: int) -> Iterator[tuple]:
        """A document's tokens; those from position loss_from on bear loss. Yields placed segments:
        (document, start, length, sequence, offset, loss)."""
        at, length = 0, document.tokens
        whole = int(min(self.limits[0], self.limits[2]))
        while length - at >= whole:
            yield document, at, whole, self.sequence, 0, max(0, min(whole, at + whole - loss_from))
            self.sequence += 1
            at += whole
        if at < length:
            if len(self.names) == len(self.sizes):
                self._close_gaps()
            self.sizes[len(self.names)] = length - at, 1, max(0, length - max(at, loss_from))
            self.names.append((document.tail(at), at, loss_from))
            self.waiting += 1
        if self.waiting >= self.pool:
            while self.waiting > self.pool // 2:
                yield from self._fill()
            self._close_gaps()

    def _close_gaps(self) -> None:
        left = [k for k, n in enumerate(self.names) if n is not None]
        self.sizes[: len(left)] = self.sizes[left]
        self.sizes[len(left) :] = np.inf
        self.names = [self.names[k] for k in left]

    def _take(self, k: int, n: int) -> tuple:
        """The first n tokens of waiting segment k; what is left of it waits on."""
        document, at, loss_from = self.names[k]
        end = at + int(self.sizes[k, 0])
        if at + n == end:
            self.names[k], self.sizes[k] = None, np.inf
            self.waiting -= 1
        else:
            self.names[k] = document, at + n, loss_from
            self.sizes[k] = end - at - n, 1, max(0, end - max(at + n, loss_from))
        return document, at

    def _fill(self, most: int | None = None) -> Iterator[tuple]:
        """One sequence of at most `most` tokens from the pool."""
        left = self.limits.copy()
        if most:
            left[0] = min(left[0], most)
        offset = 0
        while self.waiting:
            sizes = self.sizes[: len(self.names)]
            fits = np.flatnonzero((sizes <= left).all(axis=1))
            if len(fits):
                k = int(fits[np.argmax((sizes[fits] / self.limits) @ (left / self.limits))])
                n = int(sizes[k, 0])
            else:
                room = np.where(sizes[:, 2] > 0, min(left[0], left[2]), left[0])
                gap = np.where(sizes[:, 0] < np.inf, np.minimum(room, sizes[:, 0]), 0)
                k = int(np.argmax(gap))
                n = int(gap[k])
                if n < 1:
                    break
            _, at, loss_from = self.names[k]
            loss = max(0, min(n, at + n - loss_from))
            document, at = self._take(k, n)
            yield document, at, n, self.sequence, offset, loss
            offset += n
            left -= [n, 1, loss]
            if left[0] < 1 or left[1] < 1:
                break
        self.sequence += 1

    def end(self) -> Iterator[tuple]:
        """The rest of the pool."""
        while self.waiting:
            waiting = int(self.sizes[: len(self.names), 0].sum(where=self.sizes[: len(self.names), 0] < np.inf))
            yield from self._fill(1 << (waiting.bit_length() - 1) if waiting < self.limits[0] else None)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, ids.

    A document is its text's ids and the id END; a null or empty text is END alone. With `prompt`, that column's
    text precedes the text and its tokens bear no loss (null: no prompt); without, all tokens do. Each id lies in exactly
    one piece, pieces in a sequence lie side by side from offset 0, and sequence ids are unique. Rows with the
    same doc_id are documents of their own. An empty table gives no rows; other columns play no part.

    Each task packs its own rows as they come, holding POOL remainders at most, so there is no shuffle and a
    task that is run again packs the same rows into sequences of its own. Padding per task is at most what
    the segment limit forces, as the last sequences have lengths that are powers of two."""
    head = F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), head.alias("prompt"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.asarray([END], "<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * STRIDE
        ids_of, packer = encoder(vocabulary), Packer(tokens, segments, loss)

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            cut = [x[0].cut(x[1], x[2]) for x in placed]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0].doc_id for x in placed], pa.int64()),
                    pa.array([x[1] for x in placed], pa.int64()),
                    pa.array([x[2] for x in placed], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array([x[0].tokens for x in placed], pa.int64()),
                    pa.array([x[5] for x in placed], pa.int64()),
                    pa.array([first + x[3] for x in placed], pa.int64()),
                    pa.array([x[4] for x in placed], pa.int64()),
                    pa.array(cut, pa.binary()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"],
            )

        placed: list[tuple] = []
        for b in parts(batches):
            doc_ids, prompts, texts = (c.to_pylist() for c in b.columns)
            for doc_id, p, t in zip(doc_ids, prompts, texts):
                p = ids_of(p) if prompt else b""
                ids = p + ids_of(t) + end
                placed += packer.add(Document(doc_id, ids, 0, len(ids) // 4), len(p) // 4)
                if len(placed) >= 4096:
                    yield rows(placed)
                    placed = []
        placed += packer.end()
        if placed:
            yield rows(placed)

    return x.mapInArrow(tidied(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary")
