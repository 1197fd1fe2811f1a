"""Roll-ups of run logs and hardware samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bandwidth(samples: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """(by, peak, mean, peak_at) in GB/s of positive samples in MB/s; of equal peaks the first."""
    good = samples.filter(F.col(value) > 0)
    return good.groupBy(by).agg((F.max(value) / 1024).alias("peak"), (F.avg(value) / 1024).alias("mean"), F.min_by(at, F.struct(-F.col(value), F.col(at))).alias("peak_at"))


def miss_rate(samples: DataFrame, by: str) -> DataFrame:
    """(by, rate) in per cent of rows (loads, misses as text); samples that weren't counted are left out, no loads give 0."""
    loads, misses = (F.col(c).cast("string").try_cast("double") for c in ("loads", "misses"))
    sums = samples.withColumn("l", loads).withColumn("m", misses).filter("l IS NOT NULL AND m IS NOT NULL").groupBy(by).agg(F.sum("l").alias("l"), F.sum("m").alias("m"))
    return sums.select(by, F.when(F.col("l") > 0, F.col("m") / F.nullif(F.col("l"), F.lit(0.0)) * 100).otherwise(0.0).alias("rate"))


def per_config(runs: DataFrame, config: list[str], values: list[str]) -> DataFrame:
    """Means of each value over a configuration's runs, and num_runs: the largest number of values that are there."""
    out = runs.groupBy(*config).agg(*[F.avg(v).alias(v) for v in values], *[F.count(v).alias(f"_{v}") for v in values])
    most = F.greatest(*[F.col(f"_{v}") for v in values]) if len(values) > 1 else F.col(f"_{values[0]}")
    return out.select(*config, *values, most.alias("num_runs"))


def truncated(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + F.lit(1e-9)) / 10**digits


def speedups(runs: DataFrame, by: str, variant: str, value: str, names: tuple[str, str, str] = ("baseline", "runtime", "preprocessed")) -> DataFrame:
    """(by, one column for each variant, speedup): the mean by variant and the first over the last, cut to two places."""
    wide = runs.groupBy(by).pivot(variant, list(names)).agg(F.avg(value))
    return wide.withColumn("speedup", truncated(F.col(names[0]) / F.nullif(F.col(names[2]), F.lit(0.0))))


def shares(values: DataFrame, name: str) -> DataFrame:
    """``values`` with to_least (x / smallest) and percent (of the sum)."""
    span = values.agg(F.min(name).alias("_lo"), F.sum(name).alias("_sum"))
    return values.crossJoin(F.broadcast(span)).withColumn("to_least", F.col(name) / F.col("_lo")).withColumn("percent", F.col(name) / F.col("_sum") * 100).drop("_lo", "_sum")


def embedding_share(forward_emb: Column, backward_emb: Column, forward: Column, backward: Column) -> Column:
    """The embedding layers' share of a run's time; NULL where the profile lacks a figure."""
    return (forward_emb + backward_emb) / F.nullif(forward + backward, F.lit(0.0))


#: Bytes in the units that profilers print.
UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}


def to_bytes(text: Column) -> Column:
    """'12.5 Mb' to bytes; NULL for anything else."""
    number, unit = F.regexp_extract(text, r"^\s*(-?[0-9.]+)\s*([A-Za-z]+)\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*(-?[0-9.]+)\s*([A-Za-z]+)\s*$", 2))
    scale = F.when(unit == "b", 1)
    for name, size in list(UNITS.items())[1:]:
        scale = scale.when(unit == name, size)
    return F.nullif(number, F.lit("")).try_cast("double") * scale


def fraction(text: Column) -> Column:
    """'a/b' or a plain number to its value."""
    parts = F.split(text, "/")
    a, b = F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double")
    return F.when(F.size(parts) == 2, a / F.nullif(b, F.lit(0.0))).otherwise(a)
