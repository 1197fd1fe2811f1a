"""Dictionary encoding of categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.operators.splits import number_rows


def first_seen(rows: DataFrame, order: str, features: str = "feature", value: str = "raw") -> DataFrame:
    """(feature, raw, code): codes 0.. in order of first appearance by the unique column ``order``.

    The aggregate keeps one row for each distinct value, and those are numbered in ranges, so a feature of any size is
    spread over many tasks. Partial dictionaries merge by the same aggregate: ``first_seen`` of a union equals the union's.
    """
    seen = rows.groupBy(F.col(features).alias("feature"), F.col(value).alias("raw")).agg(F.min(order).alias("first_row"))
    return number_rows(seen, "first_row", name="code", by=["feature"]).select("feature", "raw", "code")


def merge_first_seen(parts: DataFrame) -> DataFrame:
    """(feature, raw, code) of partial dictionaries (feature, raw, part, code), whose parts are merged in order."""
    return first_seen(parts.withColumn("rank", F.struct("part", "code")), "rank")


def extend(known: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """A dictionary seeded with known codes: new values get the codes after the largest, in order of first appearance."""
    new = first_seen(rows.join(known.select("feature", "raw"), ["feature", "raw"], "left_anti"), order)
    base = known.groupBy("feature").agg((F.max("code") + 1).alias("base"))
    shifted = new.join(base, "feature", "left").select("feature", "raw", (F.col("code") + F.coalesce("base", F.lit(0))).alias("code"))
    return known.select("feature", "raw", "code").unionByName(shifted)


def sorted_codes(rows: DataFrame, features: str = "feature", value: str = "raw") -> DataFrame:
    """(feature, raw, code): codes by the order of the values."""
    values = rows.select(F.col(features).alias("feature"), F.col(value).alias("raw")).distinct()
    return number_rows(values, "raw", name="code", by=["feature"])


def encode(rows: DataFrame, codes: DataFrame, strict: bool = True) -> DataFrame:
    """``rows`` (feature, raw, ...) with their code; an unknown value is an error if ``strict``, else NULL."""
    out = rows.join(codes, ["feature", "raw"], "left")
    if not strict:
        return out
    return out.withColumn("code", F.coalesce("code", F.raise_error(F.concat(F.lit("no code for "), F.col("raw").cast("string"))).cast("bigint")))


def cardinalities(codes: DataFrame) -> DataFrame:
    return codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
