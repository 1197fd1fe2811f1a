"""BPE encoding and decoding of whole texts by speculation (see ``bpe``).

``encode`` gives the ids of each text, ``decode`` the text of ids by the
vocabulary's own table; both are row-wise, so they need no shuffle and a task
keeps about a megabyte of text at a time besides the words it remembers.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded one by one; other columns are kept as they are where
the caller selects them; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import map_arrow, slices, texts


def encode(docs: DataFrame, kind: str = "word", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(kind, vocabulary)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own.encode(texts(column.slice(lo, hi - lo))), pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


class Decoder:
    """Ids to text as the library joins them where the vocabulary file names no decoder: tokens with a space between."""

    def __init__(self, vocabulary: str | None = None):
        self.tokens = encoder("word", vocabulary).decode_table()

    def __call__(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of rows that ``encode`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([own(x) for x in texts(column.slice(lo, hi - lo))], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes each text and gives the digests of both; the same functions as above, without ids leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder("word", vocabulary), Decoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices(column):
                ids = own.encode(texts(column.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(back(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, DIGEST)
