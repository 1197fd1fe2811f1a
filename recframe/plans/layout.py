"""Physical layouts of embedding tables: which are merged, split, or divided to hot and cold, and where ids go.

There is a row for each feature, a few dozen; the planner works in the driver and hands out a small map that lookups
join. The order in which sizes are tested differs between the two published variants; ``order`` names it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from recframe.operators.splits import balanced_slices


@dataclass(frozen=True)
class LayoutConfig:
    merge: bool = True
    split: bool = True
    merge_below: int = 1_000  # tables up to this size may be merged
    tiny_below: int = 10  # and those up to this size are left as they are
    split_from: int = 10_000
    split_to: int = 1 << 62
    num_splits: int = 4
    hot_cold: frozenset[int] = field(default_factory=frozenset)
    order: str = "hot-first"  # or "split-first"

    def __post_init__(self):
        if self.num_splits < 1 or self.merge_below < 0 or self.split_from > self.split_to:
            raise ValueError("sizes and numbers of a layout must be positive and in order")
        if self.order not in ("hot-first", "split-first"):
            raise ValueError(f"no such order: {self.order}")


def kind_of(feature: int, n: int, c: LayoutConfig) -> str:
    if c.order == "hot-first":
        if feature in c.hot_cold:
            return "hotcold"
        if n <= c.tiny_below:
            return "tiny"
        if c.merge and n <= c.merge_below:
            return "merge"
        if c.split and c.split_from <= n <= c.split_to:
            return "split"
        return "medium"
    if c.split and c.split_from <= n <= c.split_to:
        return "split"
    if c.merge and n <= c.merge_below:
        return "merge"
    return "medium"


def merge_groups(sizes: list[tuple[int, int]], threshold: int, factor: int = 5) -> list[list[int]]:
    """Greedy groups of (feature, size) in the given order: a group closes once its sum is over factor x threshold."""
    out: list[list[int]] = []
    group: list[int] = []
    total = 0
    for feature, n in sizes:
        group.append(feature)
        total += n
        if total > factor * threshold:
            out.append(group)
            group, total = [], 0
    return out + ([group] if group else [])


def exclusive_sums(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for n in sizes:
        out.append(total)
        total += n
    return out


def split_sizes(n: int, parts: int) -> list[int]:
    return [length for _, length in balanced_slices(n, parts)]


def plan(cardinalities: list[tuple[int, int]], config: LayoutConfig) -> list[tuple[int, str, int, int, int]]:
    """(feature, kind, table, base, size): where each feature's ids lie; a split feature has a row for each part."""
    kinds = {f: kind_of(f, n, config) for f, n in cardinalities}
    size = dict(cardinalities)
    out, table = [], 0
    for group in merge_groups([(f, n) for f, n in cardinalities if kinds[f] == "merge"], config.merge_below):
        for f, base in zip(group, exclusive_sums([size[f] for f in group]), strict=True):
            out.append((f, "merge", table, base, size[f]))
        table += 1
    for f, n in cardinalities:
        if kinds[f] == "split":
            for base, length in balanced_slices(n, config.num_splits):
                out.append((f, "split", table, base, length))
                table += 1
        elif kinds[f] == "hotcold":
            out.append((f, "hotcold", table, 0, n))
            table += 2
        elif kinds[f] != "merge":
            out.append((f, kinds[f], table, 0, n))
            table += 1
    return sorted(out)


def plan_table(spark: SparkSession, cardinalities: DataFrame, config: LayoutConfig) -> DataFrame:
    """The plan of a small table (feature, n) as a table."""
    rows = [(r["feature"], r["n"]) for r in cardinalities.orderBy("feature").collect()]  # a row for each feature
    return spark.createDataFrame(plan(rows, config), "feature int, kind string, tbl int, base bigint, size bigint")


def popularity_dims(sizes: list[int], alpha: float, base_dim: int, power_of_two: bool = False, queries: list[int] | None = None) -> list[int]:
    """Embedding widths by a power of popularity; the smallest table keeps the base width.

    The exponent's scale makes the smallest table as wide as ``base_dim``; ``queries`` divide the sizes beforehand.
    """
    n = [s / (queries[k] if queries else 1) for k, s in enumerate(sizes)]
    least = min(n)
    scale = base_dim * least**alpha
    out = []
    for x in n:
        d = float(base_dim) if x == least else max(1, round(scale * x**-alpha))
        if power_of_two:
            import math

            d = 2 ** round(math.log2(d))
        out.append(int(d))
    return out
