"""Vector bin packing of examples into training sequences.

An example has a vector of sizes: tokens, segments (one for each piece) and
loss-bearing tokens. A sequence has a limit for each. The open sequence takes,
among the waiting pieces that fit, the one whose size vector has the largest dot
product with what is left of the limits, both as shares of the limits, until
none fits; where cutting is allowed, a waiting piece is then cut so that the
sequence is full. Pieces wait in a pool of bounded size, so a partition of any
length is packed in one pass with bounded memory and no shuffle.

Input rows are packed where they lie: each partition fills its own sequences, and
a sequence's id is made of the partition's number and a running number. What is
left at a partition's end is laid out in sequences of a power of two of tokens,
which need no padding.

Defined results: a null or empty text is a document of its end id alone; rows
with equal ids or equal texts are packed one by one; other columns, nulls
included, are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import map_arrow, slices, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, loss_tokens long"


@dataclass
class VectorPacker:
    """Packs pieces (key, tokens, loss) that are offered one by one; yields (sequence, [(key, from, length, loss)]).

    ``cut``: whether pieces may be cut to fill a sequence (documents) or stay whole (dialogues).
    A whole piece that breaks a limit by itself is refused with ValueError.
    """

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    cut: bool = True
    pool: int = 384
    sequences: int = 0
    waiting: list[list] = field(default_factory=list)

    def __post_init__(self):
        if self.cut and self.loss < self.tokens:
            raise ValueError("pieces can be cut only where the loss limit isn't below the token limit")
        self.limits = np.array([self.tokens, self.segments, self.loss], float)

    def offer(self, key, tokens: int, loss: int) -> Iterator[tuple[int, list]]:
        start = 0
        if self.cut:
            while tokens - start >= self.tokens:  # a full sequence of its own
                yield self._close([(key, start, self.tokens, min(self.tokens, loss))])
                start += self.tokens
                loss = max(0, loss - self.tokens)
        elif tokens > self.tokens or loss > self.loss:
            raise ValueError(f"an example of {tokens} tokens and {loss} with loss is over the limits")
        if tokens > start:
            self.waiting.append([key, start, tokens - start, loss])
        if len(self.waiting) >= self.pool:
            yield from self._pack(self.pool // 2)

    def finish(self) -> Iterator[tuple[int, list]]:
        yield from self._pack(0)

    def _close(self, pieces: list) -> tuple[int, list]:
        self.sequences += 1
        return self.sequences - 1, pieces

    def _pack(self, least: int) -> Iterator[tuple[int, list]]:
        """Fills sequences until at most ``least`` pieces wait."""
        sizes = np.array([[w[2], 1, w[3]] for w in self.waiting], float).reshape(-1, 3)
        share = sizes / self.limits
        live = np.ones(len(sizes), bool)
        while (n := int(live.sum())) > least:
            if self.cut and not least and sizes[live, 0].sum() < self.tokens and n <= self.segments:
                yield from self._tail([self.waiting[i] for i in np.flatnonzero(live)])
                live[:] = False
                break
            left, pieces = self.limits.copy(), []
            while True:
                fits = live & (sizes <= left).all(1)
                if not fits.any():
                    break
                score = np.where(fits, share @ (left / self.limits), -1)
                best = int(np.argmax(score))  # ties: the piece that waits longest
                pieces.append(tuple(self.waiting[best]))
                live[best] = False
                left -= sizes[best]
            gap = int(min(left[0], left[2]))
            if self.cut and gap and left[1] >= 1 and live.any():
                i = int(np.flatnonzero(live)[0])
                key, start, tokens, loss = self.waiting[i]
                pieces.append((key, start, gap, min(gap, loss)))
                self.waiting[i] = [key, start + gap, tokens - gap, max(0, loss - gap)]
                sizes[i] = [tokens - gap, 1, max(0, loss - gap)]
                share[i] = sizes[i] / self.limits
            yield self._close(pieces)
        self.waiting = [w for w, ok in zip(self.waiting, live, strict=True) if ok]

    def _tail(self, pieces: list) -> Iterator[tuple[int, list]]:
        """The last, incomplete sequence as sequences of a power of two of tokens each."""
        total, queue = sum(p[2] for p in pieces), [list(p) for p in pieces]
        while total:
            room, out = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                key, start, tokens, loss = queue[0]
                take = min(room, tokens)
                out.append((key, start, take, min(take, loss)))
                queue[0] = [key, start + take, tokens - take, max(0, loss - take)]
                if take == tokens:
                    queue.pop(0)
                room -= take
            yield self._close(out)


def pack_documents(docs: DataFrame, limit: int = 2048, segments: int = 512, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Packs ``docs`` (doc_id, text): one row for each piece; every id of a document lies in exactly one piece.

    Each document's ids are those of the word vocabulary and then ``end_id``; all of them bear loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        encode = encoder("word", vocabulary).encode
        packer = VectorPacker(limit, segments, limit)
        ids: dict[int, tuple] = {}
        end = int(end_id).to_bytes(4, "little")
        serial = 0
        out: list[tuple] = []

        def lay(closed):
            for sequence, pieces in closed:
                offset, total = 0, sum(p[2] for p in pieces)
                for key, start, length, loss in pieces:
                    doc_id, data, size = ids[key]
                    out.append((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), size, base | sequence, offset, total, loss))
                    offset += length
                    left = ids_left[key] = ids_left[key] - length
                    if not left:
                        del ids[key], ids_left[key]

        def table() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 9
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])
            out.clear()
            return batch

        ids_left: dict[int, int] = {}
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(column):
                for doc_id, data in zip(names[lo:hi], encode(texts(column.slice(lo, hi - lo))), strict=True):
                    data += end
                    size = len(data) // 4
                    ids[serial], ids_left[serial] = (doc_id, data, size), size
                    lay(packer.offer(serial, size, size))
                    serial += 1
            if out:
                yield table()
        lay(packer.finish())
        yield table()

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)
