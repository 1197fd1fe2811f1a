"""Row numbers, day chunks, splits, batches and shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe.session import stored


def running(rows: DataFrame, order: list[Column], values: dict[str, Column], by: list[str] | None = None, how: str = "sum", own: bool = True) -> DataFrame:
    """``rows`` with the sum (``how``: or max) of each of ``values`` over all rows before in ``order``, and this one if
    ``own``, as columns of their names.

    ``by``: begin anew in each group of these columns. No window spans all rows or a whole group: rows are ranged by
    (by, order), written once with the number of their range, and summed within their range; what the ranges before
    add is taken from one row for each range and group, of which a hot group has as many as it has ranges. The ranged
    rows are stored because a range shuffle that is planned twice may cut other ranges the second time. ``order``
    should be unique within a group: rows that are equal in it come in any order.
    """
    by, add = by or [], {"sum": F.sum, "max": F.max}[how]
    names = {c: f"in{k}" for k, c in enumerate(rows.columns)}
    places, group = [f"order{k}" for k in range(len(order))], ["part", *[names[c] for c in by]]
    packed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[c.alias(n) for c, n in zip(order, places, strict=True)], *[c.alias(f"value{k}") for k, c in enumerate(values.values())])
    ranged = stored(packed.repartitionByRange(*group[1:], *places).withColumn("part", F.spark_partition_id()), "ranged")
    some = range(len(values))
    within = Window.partitionBy(*group).orderBy(*places).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy(*group[1:]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*group).agg(*[add(f"value{k}").alias(f"whole{k}") for k in some])
    carried = whole.select(*[F.col(c).alias(f"{c}_") for c in group], *[add(f"whole{k}").over(earlier).alias(f"carried{k}") for k in some])
    same = F.col("part") == F.col("part_")
    for c in group[1:]:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    full = ranged.select("*", *[add(f"value{k}").over(within).alias(f"own{k}") for k in some]).join(carried, same)
    both = [F.greatest(f"own{k}", f"carried{k}") if how == "max" else F.coalesce(f"own{k}", F.lit(0)) + F.coalesce(f"carried{k}", F.lit(0)) for k in some]
    return full.select(*[F.col(n).alias(c) for c, n in names.items() if c not in values], *[x.alias(c) for c, x in zip(values, both, strict=True)])


def number_rows(rows: DataFrame, *order: str, name: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the given order, of all rows or in each group of ``by``."""
    return running(rows, [F.col(c) for c in order], {name: F.lit(1).cast("bigint")}, by, own=False)


def chunk_of(row: Column, total: Column, chunks: int) -> Column:
    """Which of ``chunks`` contiguous pieces a row is in; the first ones take the remainder (as ntile does, by arithmetic)."""
    size, extra = F.floor(total / chunks), total % chunks
    long_part = extra * (size + 1)
    return F.when(row < long_part, F.floor(row / (size + 1))).otherwise(extra + F.floor((row - long_part) / F.greatest(size, F.lit(1)))).cast("int")


def with_total(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """The number of rows, of all or of each group, on each row; pre-aggregated, then joined."""
    if by:
        return rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), list(by))
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))


def last_day_halves(day: Column, last: Column, row_in_day: Column, n_in_day: Column, first: str = "test", second: str = "val") -> Column:
    """Train is all days but the last, whose first half (the larger if odd) is ``first`` and the rest ``second``.

    The multi-hot reader of day files names them the other way round: ('val', 'test').
    """
    return F.when(day < last, "train").when(row_in_day < F.ceil(n_in_day / 2), first).otherwise(second)


def streaming_validation(row_in_day: Column, n_in_day: Column) -> Column:
    """The batch reader's validation rows: the last half, rounded up, which shares a row with the test half if n is odd."""
    return row_in_day >= n_in_day - F.ceil(n_in_day / 2)


def ratio_split(row: Column, total: Column, ratio: float = 0.9) -> Column:
    return F.when(row < F.floor(total * ratio), "train").otherwise("test")


def prefix_subset(rows: DataFrame, k: int, row: str = "row_id") -> DataFrame:
    """The first ``total div k`` rows."""
    return with_total(rows, name="_n").filter(F.col(row) < F.floor(F.col("_n") / k)).drop("_n")


def batches(rows: DataFrame, size: int, row: str = "row_id", drop_last: bool = False) -> DataFrame:
    """Tumbling windows by count: batch_id, from row numbers that run over all files."""
    out = rows.withColumn("batch_id", F.floor(F.col(row) / size))
    if not drop_last:
        return out
    return with_total(out, name="_n").filter(F.col("batch_id") < F.floor(F.col("_n") / size)).drop("_n")


def rank_of(batch: Column, world: int) -> Column:
    return F.pmod(batch, F.lit(world))


def equalised(batch: Column, n_batches: Column, world: int) -> Column:
    """Whether a batch is in the largest number of batches that all ranks can have."""
    return batch < F.floor(n_batches / world) * world


def balanced_slices(total: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of contiguous parts, the remainder spread over the first."""
    size, extra = divmod(total, parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < extra)
        out.append((at, n))
        at += n
    return out


def shuffled(rows: DataFrame, key: str, seed: str, day: str = "day") -> DataFrame:
    """All days but the last in one random order, cut again to days of their old sizes; the last day shuffled in itself.

    The order is that of a digest of the key, so it is the same on every run and needs no row counts beforehand.
    """
    tag = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    sizes = rows.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(day)
    spans = sizes.select(F.col(day).alias("_day"), (F.sum("_n").over(w) - F.col("_n")).alias("_from"), F.sum("_n").over(w).alias("_to"))
    last = sizes.agg(F.max(day).alias("_last"))
    tagged = rows.crossJoin(F.broadcast(last)).withColumn("_tail", F.col(day) == F.col("_last")).withColumn("_tag", tag)
    placed = number_rows(tagged, "_tail", "_tag", key, name="_place")
    # one row for each day: a small table whatever the log's size
    dealt = placed.join(F.broadcast(spans), (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to")))
    return dealt.withColumn(day, F.col("_day")).withColumn("position", F.col("_place") - F.col("_from")).drop("_day", "_from", "_to", "_last", "_tail", "_tag", "_place")
