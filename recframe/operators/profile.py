"""Access profiles, hot sets, drift and frequencies of categorical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recframe.operators.splits import running

#: Ids that one row spans before it is spread to a row for each.
SPAN = 1 << 16


def access_counts(bags: DataFrame) -> DataFrame:
    """(feature, id, cnt): each occurrence counts, duplicates in a bag included."""
    return bags.groupBy("feature", "id").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative(profile: DataFrame) -> DataFrame:
    """The profile by falling count (ties by id), with the count up to each id and the feature's total.

    The counts are summed in ranges of (feature, count, id), so a feature of any number of ids is spread over many tasks.
    """
    run = running(profile, [-F.col("cnt"), F.col("id")], {"cum": F.col("cnt")}, ["feature"])
    return run.join(run.groupBy("feature").agg(F.max("cum").alias("total")), "feature")


def hot_ids(profile: DataFrame, percent: float) -> DataFrame:
    """The smallest set of ids whose counts reach ``percent`` of all accesses; the id that crosses the line is in it."""
    return cumulative(profile).filter((F.col("cum") - F.col("cnt")) * 100 < F.col("total") * percent)


def coverage(profile: DataFrame, percent: float) -> DataFrame:
    """(feature, hot_size, covered): how much the hot ids really cover, in per cent."""
    return hot_ids(profile, percent).groupBy("feature").agg(F.count(F.lit(1)).alias("hot_size"), (F.max("cum") * 100.0 / F.max("total")).alias("covered"))


def remap(profile: DataFrame, sizes: DataFrame, percent: float) -> DataFrame:
    """(feature, id, is_hot, new_id) for every id below the feature's size (feature, n): hot and cold ids are each numbered
    by ascending id; ids without access are cold. Ids are spread in spans of SPAN, never as one array of a whole table."""
    spans = sizes.filter("n > 0").select("feature", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(SPAN).cast("bigint"))).alias("lo"))
    every = spans.repartition("feature", "lo").select("feature", F.explode(F.sequence("lo", F.least(F.col("lo") + SPAN, F.col("n")) - 1)).alias("id"))
    hot = hot_ids(profile, percent).select("feature", "id", F.lit(True).alias("is_hot"))
    marked = every.join(hot, ["feature", "id"], "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    run = running(marked, [F.col("id")], {"below": F.col("is_hot").cast("bigint")}, ["feature"], own=False)
    return run.select(*marked.columns, F.when(F.col("is_hot"), F.col("below")).otherwise(F.col("id") - F.col("below")).alias("new_id"))


def bag_offsets(batches: DataFrame) -> DataFrame:
    """(batch_id, row_id, ..., hot_offset, cold_offset) of rows with 0/1 ids on either side (column is_hot)."""
    w = Window.partitionBy("batch_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    hot = F.col("is_hot").cast("bigint")
    return batches.withColumn("hot_offset", F.sum(hot).over(w) - hot).withColumn("cold_offset", F.sum(1 - hot).over(w) - (1 - hot))


def frequencies(ids: DataFrame, n: int, name: str = "freq") -> DataFrame:
    """(id, freq) for every id from 0 to n - 1; those that don't occur have 0."""
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    return ids.sparkSession.range(n).join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def drift(rows: DataFrame, cuts: DataFrame, value: str, row: str = "row_id") -> DataFrame:
    """(cut, before, after, both, removed): distinct values before and from each cut.

    From each value's first and last row alone; a cut adds one row for each of the few cuts to a value's row.
    """
    span = rows.groupBy(value).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    early, late = F.col("lo") < F.col("cut"), F.col("hi") >= F.col("cut")
    at = span.crossJoin(F.broadcast(cuts))
    return at.groupBy("cut").agg(F.count_if(early).alias("before"), F.count_if(late).alias("after"), F.count_if(early & late).alias("both"), F.count_if(early & ~late).alias("removed"))


def norm_histogram(table: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of the vectors' L2 norms over ``bins`` bins with edges in equal steps of the logarithm; 0 and bins + 1 are outside."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    bin_ = F.call_function("width_bucket", F.log10(norm), F.lit(float(low)), F.lit(float(high)), F.lit(bins).cast("bigint"))
    return table.select(bin_.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def by_label_and_day(rows: DataFrame, day: str = "day", label: str = "label") -> DataFrame:
    return rows.groupBy(day).agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))


def at_least(counts: DataFrame, least: int, top: int) -> DataFrame:
    """The ``top`` ids with a count of ``least`` or more, by falling count."""
    return counts.filter(F.col("cnt") >= least).orderBy(F.col("cnt").desc(), "id").limit(top)
