"""Quantized tables, tiles and reconstruction errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_of(table: DataFrame) -> DataFrame:
    return table.agg(F.min(F.array_min("vec")).alias("lo"), F.max(F.array_max("vec")).alias("hi"))


def _codes(scale: Column, zero: Column) -> Column:
    return F.transform("vec", lambda x: F.least(F.greatest(F.rint(x / scale + zero), F.lit(0.0)), F.lit(255.0)).cast("smallint"))


def quantize_global(table: DataFrame, bits: int = 8) -> DataFrame:
    """(id, q, scale, zero_point): one scale for the whole table; a constant table has scale 1.

    scale = (max - min) / (2^bits - 1), zero = -rint(min / scale); codes are clamped to a byte for any number of bits.
    """
    span = range_of(table).select(F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (2**bits - 1)).otherwise(1.0).alias("scale"), "lo")
    span = span.select("scale", (-F.rint(F.col("lo") / F.col("scale"))).alias("zero_point"))
    return table.crossJoin(F.broadcast(span)).select("id", _codes(F.col("scale"), F.col("zero_point")).alias("q"), "scale", "zero_point")


def quantize_rows(table: DataFrame, bits: int = 8) -> DataFrame:
    """The same with a scale for each row; a constant row has scale 1."""
    lo, hi = F.array_min("vec"), F.array_max("vec")
    own = table.withColumn("scale", F.when(hi > lo, (hi - lo) / (2**bits - 1)).otherwise(1.0)).withColumn("zero_point", -F.rint(lo / F.col("scale")))
    return own.select("id", _codes(F.col("scale"), F.col("zero_point")).alias("q"), "scale", "zero_point")


def dequantize(codes: DataFrame) -> DataFrame:
    return codes.select("id", F.transform("q", lambda x: (x - F.col("zero_point")) * F.col("scale")).alias("vec"))


def quantize_low(table: DataFrame, bits: int = 8) -> DataFrame:
    """Row codes as fused lookups keep them: (id, q, scale, low), x = q * scale + low; bits 8 or 4."""
    lo, hi = F.array_min("vec"), F.array_max("vec")
    own = table.withColumn("low", lo).withColumn("scale", F.when(hi > lo, (hi - lo) / (2**bits - 1)).otherwise(1.0))
    return own.select("id", F.transform("vec", lambda x: F.rint((x - F.col("low")) / F.col("scale")).cast("smallint")).alias("q"), "scale", "low")


def packed_nibbles(q: Column) -> Column:
    """4-bit codes two to a byte, the first in the low half."""
    even = F.filter(q, lambda _, i: i % 2 == 0)
    odd = F.filter(q, lambda _, i: i % 2 == 1)
    return F.zip_with(even, odd, lambda a, b: (a + 16 * F.coalesce(b, F.lit(0))).cast("smallint"))


def unpacked_nibbles(packed: Column, n: int) -> Column:
    """The ``n`` codes that ``packed_nibbles`` has put two to a byte."""
    both = F.flatten(F.transform(packed, lambda x: F.array((x % 16).cast("smallint"), F.floor(x / 16).cast("smallint"))))
    return F.slice(both, 1, n)


def errors(original: DataFrame, restored: DataFrame) -> DataFrame:
    """(mse, mae, max_error, relative): over all components; relative is |difference| over |original|, a plain ratio."""
    both = original.select("id", F.col("vec").alias("a")).join(restored.select("id", F.col("vec").alias("b")), "id")
    d = F.zip_with("a", "b", lambda x, y: x - y)
    zero = F.lit(0.0)
    rows = both.select(
        F.aggregate(d, zero, lambda s, x: s + x * x).alias("sq"),
        F.aggregate(d, zero, lambda s, x: s + F.abs(x)).alias("ab"),
        F.array_max(F.transform(d, lambda x: F.abs(x))).alias("mx"),
        F.aggregate("a", zero, lambda s, x: s + x * x).alias("own"),
        F.size("a").alias("n"),
    )
    return rows.agg((F.sum("sq") / F.sum("n")).alias("mse"), (F.sum("ab") / F.sum("n")).alias("mae"), F.max("mx").alias("max_error"), F.sqrt(F.sum("sq") / F.sum("own")).alias("relative"))


def table_stats(table: DataFrame) -> DataFrame:
    """(lo, hi, mean, std) over all components, by sums; std of a sample."""
    zero = F.lit(0.0)
    rows = table.select(F.array_min("vec").alias("lo"), F.array_max("vec").alias("hi"), F.aggregate("vec", zero, lambda s, x: s + x).alias("s"), F.aggregate("vec", zero, lambda s, x: s + x * x).alias("ss"), F.size("vec").alias("n"))
    t = rows.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    return t.select("lo", "hi", (F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("std"))


def compression_totals(tables: DataFrame) -> DataFrame:
    """Of rows (raw_bytes, stored_bytes, seconds): mean, least and largest ratio (a mean of ratios) and MB per second."""
    ratio = F.col("raw_bytes") / F.col("stored_bytes")
    return tables.agg(F.avg(ratio).alias("ratio_avg"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"), (F.sum("raw_bytes") / 1048576 / F.sum("seconds")).alias("mb_per_second"))


#: Least and largest side of a frame, and the rows beyond which a table is tiled.
FRAME_MIN, FRAME_MAX, TILE_ROWS = 64, 16384, 50_000


def frame_shape(rows: int, dim: int) -> tuple[int, int, int]:
    """(width, height, tiles per line): a table as a picture, tiled in a nearly square grid if it has many rows."""
    tiles = 1
    if rows > TILE_ROWS:
        tiles = max(1, round((rows / dim) ** 0.5))
    width, height = dim * tiles, -(-rows // tiles)
    if width > FRAME_MAX or height > FRAME_MAX:
        raise ValueError("the table is too large for one frame")
    even = lambda n: n + n % 2
    return even(max(width, FRAME_MIN)), even(max(height, FRAME_MIN)), tiles


def tile(ident: Column, pos: Column, dim: int, tiles: int) -> tuple[Column, Column]:
    """(x, y) of component ``pos`` of row ``ident``: ``tiles`` rows of the table stand side by side."""
    return (F.pmod(ident, F.lit(tiles)) * dim + pos).cast("bigint"), F.floor(ident / tiles)


def untile(x: Column, y: Column, dim: int, tiles: int) -> tuple[Column, Column]:
    """(id, pos) of a pixel."""
    return (y * tiles + F.floor(x / dim)).cast("bigint"), F.pmod(x, F.lit(dim)).cast("int")
