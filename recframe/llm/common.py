"""Reading, checkpointing and byte-level helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recframe.session import shared_dir

#: Bytes of text that one vectorised step works on; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 1 << 19
#: Slices after which a worker gives back what memory is free.
SLICES_KEPT = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_if_any(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table, or None where the folder has none of that name."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, and still there when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to and read again from the shared folder as Parquet, for intermediate results that are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing will read again."""
    removed(df.sparkSession, df.stored_at)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of a string column holding about ``limit`` bytes each, one row at least."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    lo = done = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield lo, hi
        lo, done = hi, done + 1
        if done % SLICES_KEPT == 0:
            release()


def rows_of(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of a few rows that the driver holds. It is given to Spark by Arrow: of a list of rows Spark makes an RDD that
    starts Python workers of a kind of their own, which then stay in each executor beside the others."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives memory that is free in this process back to the system; glibc keeps what large arrays leave behind."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``; a worker that has come to the end of its partition, and may wait for the next one, holds no spare memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


#: For hashing: odd constants of a fixed seed, and the masks of the first 0 to 8 bytes of a word.
_ODD = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)
WORD_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans beyond this many bytes are hashed one by one.
LONG = 1 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, and from its end, as words; zeros follow the last byte."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``data``, equal for equal bytes wherever they stand.

    A span is read as words of eight bytes; each is mixed with its place in the span, and the mixed words add up. The
    work is a few steps for each word of eight bytes, with memory in proportion to the spans.
    """
    size = ends - starts
    out = size.astype(np.uint64) * _ODD[0]
    words = words_at(data)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    place = 0
    while len(live):
        place += 1
        out[live] += mix((words[at] & WORD_MASK[np.minimum(left, 8)]) ^ np.uint64(place * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def words_of(rows: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each row); words are runs of bytes other than ASCII white space.

    Memory is in proportion to the rows given, some twenty bytes a word: callers give about SLICE_BYTES, or one long row.
    """
    data = np.frombuffer(b"\n".join(rows), np.uint8) if rows else np.zeros(0, np.uint8)
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts = edge[~gap[edge]]
    ends = edge[gap[edge]]
    if len(data) and not gap[0]:
        starts = np.concatenate(([0], starts))
    if len(data) and not gap[-1]:
        ends = np.concatenate((ends, [len(data)]))
    row_ends = np.cumsum([len(r) + 1 for r in rows]) - 1 if rows else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, row_ends, side="left"), prepend=0)
    return span_hashes(data, starts, ends), counts


def ngram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles, number for each row); a row of fewer words gives its whole sequence as one, an empty row none."""
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = np.zeros(len(words), np.uint64)
    for k in range(n):
        shifted = np.zeros(len(words), np.uint64)
        ok = at + k < np.repeat(counts, counts)
        shifted[: max(len(words) - k, 0)] = words[k:]
        key = key * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, shifted * _ODD[k + 11], np.uint64(k + 1))
    keep = (at + n <= np.repeat(counts, counts)) | ((at == 0) & (np.repeat(counts, counts) < n))
    return mix(key[keep]), np.bincount(row[keep], minlength=rows).astype(np.int64)


def sets_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, flat, and how many each row has."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], np.bincount(r[first], minlength=len(counts)).astype(np.int64)


def frequent(ids: DataFrame, total: int, hot: int = 1024, least: int = 256) -> list[tuple[int, int]]:
    """(id, copies) of the values of ``ids`` (id) that more than one in ``hot`` of ``total`` rows have, and ``least`` rows:
    fewer than ``hot`` times the rows of ``ids`` by ``total``, whatever the data. ``copies``: how many such shares they make."""
    share = max(least, -(-total // hot))
    rows = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).collect()
    return [(r["id"], -(-r["n"] // share)) for r in rows]


#: Rows, of a few numbers each, up to which a counted table is broadcast: some megabytes.
SMALL = 1 << 16


def small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` short rows, to be broadcast if these are few."""
    return F.broadcast(df) if n <= SMALL else df


def skewed_join(left: DataFrame, right: DataFrame, key: str, by: str, often: list[tuple[int, int]], how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each value of ``key`` (and the columns ``also``).

    The rows of ``left`` with one of the values in ``often``, as ``frequent`` found them, are dealt by a hash of the
    column ``by`` to that many copies of the value's row of ``right``.
    """
    if not often:
        return left.join(right, [key, *also], how)
    table = F.broadcast(rows_of(left.sparkSession, often, pa.schema({key: pa.int64(), "salts": pa.int32()})))
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(table, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    copied = right.join(table, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [key, *also, "salt"], how).drop("salt")
