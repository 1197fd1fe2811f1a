"""Embedding lookups: bags of ids joined with tables of vectors and pooled.

Bags are rows (row_id, id[, w]); tables are rows (id, vec). Every physical layout (merged, range-split, hot and cold)
ends in the same core: an equi-join on the id and one aggregate for each component, which Spark combines on the map
side, so a row or id of any weight shuffles one partial sum for each task. The join's strategy is left to Spark: a
table below the broadcast threshold is broadcast, a larger one is shuffled by id or found bucketed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.functions.scalar import as_doubles


def pool(joined: DataFrame, dim: int, mode: str = "sum", weight: Column | None = None, key: str = "row_id") -> DataFrame:
    """(key, vec) of rows (key, vec): the vectors' sum, mean or maximum by component."""
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[mode]

    def part(k: int) -> Column:
        x = F.get("vec", F.lit(k)).cast("double")
        return how(x if weight is None else x * weight).alias(f"_{k}")

    sums = joined.groupBy(key).agg(*[part(k) for k in range(dim)])
    return sums.select(key, F.array(*[f"_{k}" for k in range(dim)]).alias("vec"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def with_empty(pooled: DataFrame, spine: DataFrame, dim: int, key: str = "row_id") -> DataFrame:
    """One row for each row of ``spine``: a row without ids gets the zero vector."""
    return spine.select(key).join(pooled, key, "left").withColumn("vec", F.coalesce("vec", zeros(dim)))


def bag(bags: DataFrame, table: DataFrame, dim: int, mode: str = "sum", spine: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(row_id, vec): pooled vectors of each row's ids; ``weighted``: times the column w of the bags."""
    out = pool(bags.join(table.select("id", "vec"), "id"), dim, mode, F.col("w") if weighted else None)
    return out if spine is None else with_empty(out, spine, dim)


def bag_with_row_weights(bags: DataFrame, table: DataFrame, dim: int) -> DataFrame:
    """The weighted sum whose weights belong to the table's rows (column w)."""
    return pool(bags.select("row_id", "id").join(table.select("id", "vec", "w"), "id"), dim, weight=F.col("w"))


def combine(a: Column, b: Column, how: str) -> Column:
    if how == "concat":
        return F.concat(a, b)
    return F.zip_with(a, b, (lambda x, y: x * y) if how == "mult" else (lambda x, y: x + y))


def quotient_remainder(bags: DataFrame, quotients: DataFrame, remainders: DataFrame, collisions: int, dim: int, how: str = "mult", mode: str = "sum") -> DataFrame:
    """Two lookups, of id div c and of id mod c, each pooled by itself and then combined (integer division, exact for all ids)."""
    q = bag(bags.withColumn("id", F.expr(f"id div {collisions}")), quotients, dim, mode)
    r = bag(bags.withColumn("id", F.pmod("id", F.lit(collisions))), remainders, dim, mode)
    both = q.withColumnRenamed("vec", "q").join(r.withColumnRenamed("vec", "r"), "row_id")
    return both.select("row_id", combine(F.col("q"), F.col("r"), how).alias("vec"))


def projected(bags: DataFrame, table: DataFrame, width: int, projection: list[list[float]]) -> DataFrame:
    """A lookup of narrow vectors, multiplied by a matrix [base dim][width] up to the base dimension."""
    low = bag(bags, table, width)
    rows = [F.aggregate(F.zip_with("vec", F.array(*map(F.lit, row)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in projection]
    return low.select("row_id", F.array(*rows).alias("vec"))


def merged(bags: DataFrame, offsets: DataFrame, big: DataFrame, dim: int) -> DataFrame:
    """Bags (row_id, feature, id) looked up in one concatenated table by id + the feature's offset: (row_id, feature, vec)."""
    moved = bags.join(offsets.select("feature", "base"), "feature").withColumn("id", F.col("id") + F.col("base"))
    keyed = moved.withColumn("row_id", F.struct("row_id", "feature"))
    return pool(keyed.join(big.select("id", "vec"), "id"), dim).select("row_id.row_id", "row_id.feature", "vec")


def concatenated(tables: DataFrame, offsets: DataFrame) -> DataFrame:
    """The big table (id, vec) of many small ones (feature, id, vec)."""
    return tables.join(offsets.select("feature", "base"), "feature").select((F.col("id") + F.col("base")).alias("id"), "vec")


def split_part(ident: Column, n: int, parts: int) -> tuple[Column, Column]:
    """(sub-table, id in it) of contiguous parts of nearly equal size, by arithmetic: the join stays an equi-join."""
    size, extra = divmod(n, parts)
    edge = extra * (size + 1)
    part = F.when(ident < edge, F.floor(ident / (size + 1))).otherwise(extra + F.floor((ident - edge) / max(size, 1)))
    base = F.when(part < extra, part * (size + 1)).otherwise(edge + (part - extra) * size)
    return part.cast("int"), (ident - base).cast("bigint")


def split_lookup(bags: DataFrame, table: DataFrame, n: int, parts: int, dim: int) -> DataFrame:
    """A lookup in range-split sub-tables; rows that a sub-table doesn't hold add nothing to its part of the sum."""
    part, at = split_part(F.col("id"), n, parts)
    routed = bags.select("row_id", part.alias("part"), at.alias("at"))
    stored = table.select(part.alias("part"), at.alias("at"), "vec")
    return pool(routed.join(stored, ["part", "at"]), dim)


def hot_cold(bags: DataFrame, table: DataFrame, remap: DataFrame, dim: int) -> DataFrame:
    """A lookup through a remap (id, is_hot, new_id) to a hot and a cold table, the two pooled and added.

    The hot table is small by construction, so Spark broadcasts it where its size is below the threshold; ids that
    are hot never take part in the cold table's shuffle, which takes the skew out of it.
    """
    ids = bags.join(remap, "id").select("row_id", "is_hot", "new_id")
    stored = table.join(remap, "id").select("is_hot", F.col("new_id"), "vec")
    hot = ids.filter("is_hot").join(stored.filter("is_hot").select("new_id", "vec"), "new_id").select("row_id", "vec")
    cold = ids.filter("NOT is_hot").join(stored.filter("NOT is_hot").select("new_id", "vec"), "new_id").select("row_id", "vec")
    return pool(hot.unionByName(cold), dim)


def hot_cold_stored(rows: DataFrame, hot_table: DataFrame, cold_table: DataFrame, dim: int) -> DataFrame:
    """The same over stored rows (row_id, hot ARRAY, cold ARRAY) whose ids were remapped beforehand; an empty side adds zero."""
    hot = rows.select("row_id", F.explode("hot").alias("new_id")).join(hot_table.select("new_id", "vec"), "new_id")
    cold = rows.select("row_id", F.explode("cold").alias("new_id")).join(cold_table.select("new_id", "vec"), "new_id")
    return with_empty(pool(hot.select("row_id", "vec").unionByName(cold.select("row_id", "vec")), dim), rows, dim)


def stored_remap(bags: DataFrame, remap: DataFrame) -> DataFrame:
    """(row_id, hot ARRAY, cold ARRAY) of bags (row_id, pos, id): what ``hot_cold_stored`` reads."""
    ids = bags.join(remap, "id")

    def side(hot: bool) -> Column:
        kept = F.collect_list(F.when(F.col("is_hot") == hot, F.struct("pos", "new_id")))
        return F.transform(F.array_sort(kept), lambda x: x["new_id"])

    return ids.groupBy("row_id").agg(side(True).alias("hot"), side(False).alias("cold"))


def multi_hot(ids: DataFrame, expansion: DataFrame) -> DataFrame:
    """One-hot ids (row_id, id) to (row_id, pos, id): position 0 is the own id, the others come from (id, pos, other)."""
    own = ids.select("row_id", F.lit(0).alias("pos"), "id")
    return own.unionByName(ids.join(expansion, "id").select("row_id", "pos", F.col("other").alias("id")))


def quantized_bag(bags: DataFrame, table: DataFrame, dim: int) -> DataFrame:
    """A lookup of vectors stored by row as codes with scale and low: (id, q ARRAY, scale, low)."""
    plain = table.select("id", F.transform("q", lambda x: x * F.col("scale") + F.col("low")).alias("vec"))
    return bag(bags, plain, dim)


def class_weight(label: Column, weights: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), label.cast("int") + 1)


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that two datasets don't share by key, with both sides' rows; empty if they are equal."""
    names = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*names).alias("left"))
    right = b.select(*keys, F.struct(*names).alias("right"))
    return left.join(right, keys, "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def vectors(embeddings: DataFrame) -> DataFrame:
    """(id, vec) in doubles of a table (vec_id, embedding)."""
    return embeddings.select(F.col("vec_id").alias("id"), as_doubles("embedding").alias("vec"))
