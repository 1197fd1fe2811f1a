"""Seeded synthetic batches: the same rows on every run, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(*keys: Column) -> Column:
    """A number in [0, 1) settled by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def normal(*keys: Column) -> Column:
    """A standard normal number settled by its keys (Box-Muller)."""
    u, v = unit(*keys, F.lit("u")), unit(*keys, F.lit("v"))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def uniform_bags(spark: SparkSession, rows: int, tables: list[int], k: int, fixed: bool = False, seed: int = 0) -> DataFrame:
    """(row_id, feature, ids): bags of uniform ids round(u (n - 1)), distinct and sorted, so of ``k`` ids at most; their size is
    ``k`` or a uniform number up to it, one at least."""
    sizes = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(n).alias("n")) for f, n in enumerate(tables)])
    cells = spark.range(rows).select(F.col("id").alias("row_id"), F.explode(sizes).alias("t")).select("row_id", "t.*")
    limit = F.least(F.col("n"), F.lit(k))
    size = limit if fixed else F.greatest(F.lit(1), F.rint(unit(F.lit(seed), F.col("row_id"), F.col("feature"), F.lit("size")) * limit).cast("int"))
    ids = F.transform(F.sequence(F.lit(1), size), lambda j: F.rint(unit(F.lit(seed), F.col("row_id"), F.col("feature"), j) * (F.col("n") - 1)).cast("bigint"))
    return cells.select("row_id", "feature", F.array_sort(F.array_distinct(ids)).alias("ids"))


def gaussian_bags(spark: SparkSession, rows: int, tables: list[int], k: int, low: float, high: float, mu: float | None = None, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Bags of clipped normal draws, scaled to each table. Draws are made distinct before they are cut to integers, so
    an id may occur twice."""
    mu = (low + high) / 2 if mu is None else mu
    sizes = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(n).alias("n")) for f, n in enumerate(tables)])
    cells = spark.range(rows).select(F.col("id").alias("row_id"), F.explode(sizes).alias("t")).select("row_id", "t.*")

    def draw(j: Column) -> Column:
        x = normal(F.lit(seed), F.col("row_id"), F.col("feature"), j) * sigma + mu
        return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))

    draws = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), draw)))
    return cells.select("row_id", "feature", F.transform(draws, lambda x: F.least(F.floor((x - low) / max(high - low, 1e-9) * F.col("n")), F.col("n") - 1)).alias("ids"))


def trace_bags(trace: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(row_id, feature, ids): a trace (feature, pos, ref) cut to bags (feature, row_id, start, size); ids fold into the table."""
    at = trace.join(sizes, "feature").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size")))
    return at.groupBy("row_id", "feature").agg(F.array_sort(F.collect_set(F.pmod("ref", F.lit(n)))).alias("ids"))


def dense(spark: SparkSession, rows: int, dim: int, seed: int = 0) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: unit(F.lit(seed), F.lit("dense"), F.col("id"), j)).alias("dense"))


def targets(rows: DataFrame, rounded: bool = False, seed: int = 0) -> DataFrame:
    u = unit(F.lit(seed), F.lit("target"), F.col("row_id"))
    return rows.withColumn("y", F.rint(u) if rounded else u)


def n_batches(rows: int, size: int) -> int:
    return -(-rows // size)


def expansion(spark: SparkSession, n: int, k: int, how: str = "uniform", seed: int = 0) -> DataFrame:
    """(id, pos, other) for the multi-hot join: k - 1 further ids of each id, uniform or of a Pareto law with exponent 0.25, modulo n."""
    u = unit(F.lit(seed), F.col("id"), F.col("pos"))
    other = F.floor(u * n) if how == "uniform" else F.pmod(F.floor(F.least(F.pow(1 - u, F.lit(-4.0)) - 1, F.lit(9e15))), F.lit(n))
    cells = spark.range(n).withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))) if k > 1 else spark.range(n).withColumn("pos", F.lit(1)).limit(0)
    return cells.select("id", "pos", other.cast("bigint").alias("other"))
