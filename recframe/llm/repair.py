"""Token-id files compressed by Re-Pair grammars.

A directory written by ``write_ids`` holds the ids of all documents in ascending
doc_id order. Its rows are shards of about a million ids of whole documents:

- ``partition``, ``shard``: place in the order; ``n_ids``: ids in the shard; ``n_null``: documents without an id, which
  stand first
- ``doc_ids``: int64 each; ``doc_ends``: int64 each, symbols up to each document's end
- ``rules``: uint32 pairs; rule k stands for its two symbols, and its own symbol is ``base`` + k
- ``lengths``: uint32 each, how many ids rule k expands to
- ``symbols``: what is left of the ids, uint16 or uint32 by ``width``

Rules never cross a document's end, so a document is decoded from its own
symbols and the rules alone; the expansion lengths give the place of any id
without expanding what stands before it. Each round counts all neighbouring
pairs of the shard and replaces every frequent one at once by new symbols; in a
run of overlapping occurrences every second is replaced. Rounds go on until no
pair inside a document is frequent; symbols are 32 bits wide where 16 run out.

Defined results: null and empty texts hold the end id alone; rows with equal
doc_id stand next to each other, by the hash of their texts, and rows with a null doc_id first; other columns
are ignored; an empty table gives an empty directory that reads as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_arrow, slices, texts

FORMAT = "partition int, shard int, n_ids long, n_null int, base int, width int, doc_ids binary, doc_ends binary, rules binary, lengths binary, symbols binary"


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # [k, 2]
    lengths: np.ndarray  # [k]
    symbols: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all symbols' ids one after another, where each symbol's begin, how many it has). A rule names older symbols only."""
        size = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        starts = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        depths, base = [], self.base
        for a, b in self.rules.tolist():
            x, y = depths[a - base] if a >= base else 0, depths[b - base] if b >= base else 0
            depths.append(x + 1 if x > y else y + 1)
        level = np.array(depths, np.int64)
        for depth in range(1, int(level.max(initial=0)) + 1):
            k = np.flatnonzero(level == depth)
            at = starts[k + base]
            for side in (0, 1):
                s = self.rules[k, side].astype(np.int64)
                flat[_spread(at, size[s])] = flat[_spread(starts[s], size[s])]
                at = at + size[s]
        return flat, starts, size

    def expand(self, symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The ids of some of the symbols."""
        flat, starts, size = table
        s = symbols.astype(np.int64)
        return flat[_spread(starts[s], size[s])]

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return np.concatenate((np.ones(self.base, np.int64), self.lengths))[symbols.astype(np.int64)]


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def compress(ids: np.ndarray, doc: np.ndarray, base: int, least: int = 6, rounds: int | None = None) -> tuple[Grammar, np.ndarray]:
    """The grammar of one shard. ``doc``: the document of each id, ascending. Returns also the document of each symbol.

    ``least``: occurrences that make a pair frequent; ``rounds``: at most so many rounds of replacement, None: until no
    pair inside a document is frequent.
    """
    symbols, rules, lengths, next_symbol = ids.astype(np.uint32), [], [np.zeros(0, np.int64)], base
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)[: len(doc)])  # symbols of their documents
    names = doc[last].astype(np.int32)
    after = earlier = None  # the next and the last symbol that is left, once replaced ones stay where they are
    ask = np.ones(len(symbols), bool)  # where a pair begins that may be frequent
    ask[last] = False
    at = np.flatnonzero(ask)
    done = 0
    while len(at) and done != rounds:
        done += 1
        half = 32
        dense = after is None and 2 * len(at) > len(symbols)  # all pairs are counted; more than those asked for doesn't matter
        if dense and next_symbol <= 1 << 16:
            half = 16
            pair = symbols[:-1] << np.uint32(16) | symbols[1:]
        elif dense:
            pair = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        else:
            right = at + 1 if after is None else after[at]
            pair = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[right]
        if len(pair) > 1 << 16 and 3 * len(pd.unique(pair[:: len(pair) >> 13])) > 2 << 13:  # many are rare; none in a light bucket is frequent enough
            bits = len(pair).bit_length() - 1
            bucket = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
            heavy = (np.bincount(bucket, minlength=1 << bits) >= least)[bucket]
            if dense:
                heavy[last[:-1]] = False
            keep = np.flatnonzero(heavy)
            at, pair, dense = keep if dense else at[keep], pair[keep], False
            right = at + 1 if after is None else after[at]
        back, found = pd.factorize(pair, size_hint=len(pair) // 8)
        weight = np.bincount(back, minlength=len(found))
        if dense:
            weight -= np.bincount(back[last[:-1]], minlength=len(found))
        weight = weight.astype(np.int32)[back]
        if dense:
            weight[last[:-1]] = 0
        often = weight >= least
        if not often.any():
            break
        # Of pairs that overlap, the more frequent one wins; equal ones: every second from the left.
        win = often.copy()
        if dense:
            win[1:] &= weight[1:] >= weight[:-1]
            win[:-1] &= weight[:-1] >= weight[1:]
            win = np.flatnonzero(win)
            ask = np.append(often, False)
            at, back = win, back[win]
            right = at + 1
        else:
            apart = at[1:] != right[:-1]
            win[1:] &= apart | (weight[1:] >= weight[:-1])
            win[:-1] &= apart | (weight[:-1] >= weight[1:])
            win = np.flatnonzero(win)
            ask = np.zeros(len(symbols), bool)
            ask[at[often]] = True
            at, right, back = at[win], right[win], back[win]
        follows = np.zeros(len(at) + 1, bool)
        follows[1:-1] = at[1:] == right[:-1]
        run = np.flatnonzero(follows[:-1] | follows[1:])
        if len(run):
            k = np.arange(len(run))
            k -= np.maximum.accumulate(np.where(follows[run], 0, k))
            stay = np.ones(len(at), bool)
            stay[run[k % 2 == 1]] = False
            stay = np.flatnonzero(stay)
            at, right, back = at[stay], right[stay], back[stay]
        n = np.bincount(back, minlength=len(found))
        # Half of the most frequent pairs' occurrences stand here at least, so one of them is used, from ``least`` 4 on.
        used = n >= max(2, least // 2)
        if not used.any():
            break
        code = np.cumsum(used) - 1
        if not used.all():
            take = np.flatnonzero(used[back])
            at, right, back = at[take], right[take], back[take]
        new = np.stack((found[used] >> half, found[used] & ((1 << half) - 1)), 1).astype(np.int64)
        known = np.concatenate(lengths)
        size = np.where(new < base, 1, known[np.where(new < base, 0, new - base)] if len(known) else 1).sum(1)
        rules.append(new)
        lengths.append(size)
        symbols[at] = (next_symbol + code).astype(np.uint32)[back]
        next_symbol += len(new)
        place = np.minimum(np.searchsorted(right, last), len(right) - 1)
        last = np.where(right[place] == last, at[place], last)
        if after is None and 16 * len(at) <= len(symbols):  # from now on few go in a round
            after, earlier = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols))
            gone = np.zeros(len(symbols), bool)
        # A pair of older symbols can only become rarer: next are those that were frequent, and those of the new symbols.
        ask[at] = True
        if after is None:
            stay = np.ones(len(symbols), bool)
            stay[right] = False
            before = at[at > 0] - 1
            ask[before] = True
            ask[before[~stay[before]] - 1] = True  # the second half of another replaced pair: its first half is what now stands before
            ask[last] = False
            stay = np.flatnonzero(stay)
            symbols, ask = symbols[stay], ask[stay]
            last -= np.searchsorted(right, last)
        else:
            follower = after[right]
            after[at], earlier[follower], gone[right] = follower, at, True
            before = earlier[at]
            ask[before[before >= 0]] = True
            ask[right] = ask[last] = False
        at = np.flatnonzero(ask)
    if after is not None:
        last = last - np.cumsum(gone)[last]
        symbols = symbols[~gone]
    return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.concatenate(lengths), symbols.astype(np.int64)), np.repeat(names, np.diff(last, prepend=-1))


def shard_ids(docs: DataFrame, kind: str = "byte", end_id: int = 0, shard: int = 1 << 20, vocabulary: str | None = None) -> DataFrame:
    """Documents in ascending doc_id order as compressed shards: one row each, in the module's format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        own = encoder(kind, vocabulary)
        base = own.library.get_vocab_size(with_added_tokens=True)
        end = int(end_id).to_bytes(4, "little")
        names: list = []
        parts: list[bytes] = []
        held, serial = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, serial
            n = np.array([len(p) // 4 for p in parts], np.int64)
            g, doc = compress(np.frombuffer(b"".join(parts), "<u4"), np.repeat(np.arange(len(n)), n), base)
            ends = np.cumsum(np.bincount(doc, minlength=len(n)))
            width = 2 if base + len(g.rules) <= 1 << 16 else 4
            row = [partition, serial, int(n.sum()), names.count(None), base, width, np.array([0 if x is None else x for x in names], "<i8").tobytes(), ends.astype("<i8").tobytes(), g.rules.astype("<u4").tobytes(), g.lengths.astype("<u4").tobytes(), g.symbols.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 5
            names.clear()
            parts.clear()
            held, serial = 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in FORMAT.split(", ")])

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(column):
                for name, data in zip(ids[lo:hi], own.encode(texts(column.slice(lo, hi - lo))), strict=True):
                    names.append(name)
                    parts.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= shard:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "copy").select("doc_id", "text")
    return map_arrow(ordered, run, FORMAT)


def write_ids(docs: DataFrame, path: str, **options) -> None:
    """Writes the files of ``shard_ids`` to a folder that all executors share."""
    shard_ids(docs, **options).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a directory."""
    return spark.read.schema(FORMAT).parquet(path)


def places(shards: DataFrame) -> DataFrame:
    """(partition, shard, first_id): how many ids stand before each shard.

    A running sum over partitions and then over a partition's shards; the first has one row for each partition, so no
    task sees a row for each shard of the whole directory.
    """
    sums = shards.groupBy("partition").agg(F.sum("n_ids").alias("n"))
    before = sums.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("before_partition"))
    inner = Window.partitionBy("partition").orderBy("shard")
    own = shards.select("partition", "shard", "n_ids").withColumn("before_shard", F.sum("n_ids").over(inner) - F.col("n_ids"))
    return own.join(before, "partition").select("partition", "shard", (F.col("before_partition") + F.col("before_shard")).alias("first_id"))


DOCUMENT = "partition int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _grammar(row: dict) -> Grammar:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return Grammar(row["base"], rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["symbols"], f"<u{row['width']}"))


def _names(row: dict) -> list[int | None]:
    return [None] * row["n_null"] + np.frombuffer(row["doc_ids"], "<i8").tolist()[row["n_null"] :]


def decode_one(row: dict, number: int) -> np.ndarray:
    """The ids of one document of a shard's row, by its number there: from its own symbols and the rules alone."""
    g = _grammar(row)
    ends = np.frombuffer(row["doc_ends"], "<i8")
    return g.expand(g.symbols[ends[number - 1] if number else 0 : ends[number]], g.expansions())


def decode_shard(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of all documents of a shard's row; the shard is expanded at once and cut by the symbols' lengths."""
    g = _grammar(row)
    flat = g.expand(g.symbols, g.expansions())
    upto = np.concatenate(([0], np.cumsum(g.sizes(g.symbols))))
    ends = upto[np.frombuffer(row["doc_ends"], "<i8")].tolist()
    for doc_id, begin, end in zip(_names(row), [0, *ends], ends, strict=False):
        yield doc_id, flat[begin:end]


def documents_of(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document: its place among all ids, its number of ids and their CRC.

    Shards are decoded where they are read; only the documents' few numbers meet the shards' places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                at, out = 0, []
                for doc_id, ids in decode_shard(row):
                    out.append((row["partition"], row["shard"], doc_id, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).data)))
                    at += len(ids)
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DOCUMENT.split(", ")])

    found = map_arrow(shards, run, DOCUMENT).join(places(shards), ["partition", "shard"])
    return found.select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
