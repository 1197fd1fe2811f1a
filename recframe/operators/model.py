"""The whole forward pass of the ranking model: lookup, interaction, layers, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.functions.scalar import clamp_score
from recframe.operators import interact


def pooled_features(bags: DataFrame, tables: DataFrame, dim: int) -> DataFrame:
    """(row_id, pooled MAP<feature, vec>) of bags (row_id, feature, id) over tables (feature, id, vec), pooled by sum.

    One join and two aggregates that combine before their shuffles; a row's map has an entry for each of its features.
    """
    found = bags.join(tables, ["feature", "id"])
    sums = found.groupBy("row_id", "feature").agg(*[F.sum(F.get("vec", F.lit(k))).alias(f"v{k}") for k in range(dim)])
    entry = F.struct("feature", F.array(*[f"v{k}" for k in range(dim)]).alias("vec"))
    return sums.groupBy("row_id").agg(F.map_from_entries(F.collect_list(entry)).alias("pooled"))


def forward(rows: DataFrame, bags: DataFrame, tables: DataFrame, features: list[int], dim: int, bottom: list[interact.Layer], top: list[interact.Layer], how: str = "dot", with_self: bool = False, threshold: float = 0.0) -> DataFrame:
    """``rows`` (row_id, dense, ...) with their score p, between ``threshold`` and 1 - ``threshold``.

    The dense values go through the ``bottom`` layers, whose output has ``dim`` values; a feature without ids in a row is a zero
    vector; the interaction goes through the ``top`` layers, the last of which ends in a sigmoid.
    """
    if len(bottom[-1][1]) != dim:
        raise ValueError(f"the bottom layers end in {len(bottom[-1][1])} values, the tables have {dim}")
    interact.check_width(len(top[0][0][0]), len(features) + 1, dim, how, with_self)
    zero = F.array(*[F.lit(0.0)] * dim)
    full = rows.withColumn("bottom", interact.mlp(F.col("dense"), bottom)).join(pooled_features(bags, tables, dim), "row_id", "left")
    for f in features:
        full = full.withColumn(f"feature{f}", F.coalesce(F.try_element_at("pooled", F.lit(f)), zero))
    columns = [F.col("bottom"), *[F.col(f"feature{f}") for f in features]]
    z = interact.cat_interaction(columns) if how == "cat" else interact.dot_interaction(columns, with_self)
    full = full.withColumn("z", z)
    p = F.get(interact.mlp(F.col("z"), top, len(top) - 1), F.lit(0))
    return full.select(*rows.columns, (clamp_score(p, threshold) if threshold else p).alias("p"))


def limited(batches: DataFrame, most: int, batch: str = "batch_id") -> DataFrame:
    """The first ``most`` batches, as a run that stops early sees them; all of them if ``most`` is 0."""
    return batches.filter(F.col(batch) < most) if most else batches


def table_sizes(bags: DataFrame) -> DataFrame:
    """(feature, n): the size of each feature's table, its largest id and one more; ids that don't occur count."""
    return bags.groupBy("feature").agg((F.max("id") + 1).alias("n"))


def layer_sizes(config: str, first: int | None = None, last: int | None = None) -> list[int]:
    """The sizes in a text such as 13-512-64; ``first`` and ``last`` are what they must begin and end with."""
    parts = config.split("-")
    if not all(p.isdecimal() and int(p) > 0 for p in parts):
        raise ValueError(f"not a list of layer sizes: {config!r}")
    sizes = [int(p) for p in parts]
    for want, have, name in ((first, sizes[0], "begins"), (last, sizes[-1], "ends")):
        if want is not None and want != have:
            raise ValueError(f"{config!r} {name} with {have}, not {want}")
    return sizes
