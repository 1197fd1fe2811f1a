"""Locality of access traces: stack distances, their distribution, and traces made from one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recframe.operators.splits import number_rows, running
from recframe.session import stored


#: Accesses of a block: at least so many, and so many times the root of a stream's length.
BLOCK, GROWTH = 1 << 15, 32


def greater_before(values: np.ndarray) -> np.ndarray:
    """How many values before each one are greater than it; whole-array steps, one for each bit of a rank."""
    n = len(values)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    at = np.arange(n)  # elements in groups of equal higher bits, each group in order of place
    for bit in range((n - 1).bit_length() - 1, -1, -1):
        r = rank[at]
        one = r >> bit & 1
        group = r >> (bit + 1)
        ones = np.cumsum(one) - one
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        base = ones[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
        zero = one == 0
        out[at[zero]] += (ones - base)[zero]
        at = at[np.argsort(r >> bit, kind="stable")]
    return out


def stack_distance(trace: DataFrame, stream: str = "stream", pos: str = "pos", ref: str = "ref", block: int | None = None) -> DataFrame:
    """(stream, pos, ref, sd) of each stream's accesses.

    How many different refs were touched since the last touch of this one, itself included: an immediate repeat has 1, a
    first touch 0. An access at place k whose ref was last touched at p has k - p less the accesses before k whose own
    last touch is not before p. Those are counted in three parts, none of which sees a whole stream: within blocks of
    neighbouring places; between blocks, among accesses whose last touches lie in one block; and for whole blocks of
    places and of last touches by a table of counts of either, summed along both. ``block``: accesses of a block.
    """
    kinds = dict(trace.dtypes)
    seen = number_rows(trace.select(F.col(stream).alias("s"), F.col(pos).alias("pos"), F.col(ref).alias("ref")), "pos", name="k", by=["s"])
    seen = running(seen, [F.col("k")], {"p": F.col("k")}, ["s", "ref"], how="max", own=False)
    longest = seen.agg(F.max("k")).collect()[0][0] or 0
    size = block or max(BLOCK, GROWTH * int((longest + 1) ** 0.5))
    seen = stored(seen.withColumn("b", F.floor(F.col("k") / size)).withColumn("c", F.floor(F.col("p") / size)), "touches")
    again = seen.filter("p is not null").select("s", "k", "p", "b", "c")

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        return pd.DataFrame({"s": part["s"], "k": part["k"], "inner": greater_before(part["p"].to_numpy())})

    def far(part: pd.DataFrame) -> pd.DataFrame:
        # all greater ones before, less those of the same block, which ``near`` has counted
        part = part.sort_values("k")
        every = greater_before(part["p"].to_numpy())
        for places in part.reset_index(drop=True).groupby("b").indices.values():
            every[places] -= greater_before(part["p"].to_numpy()[places])
        return pd.DataFrame({"s": part["s"], "k": part["k"], "inner": every})

    counted = f"s {kinds[stream]}, k bigint, inner bigint"
    inner = again.groupBy("s", "b").applyInPandas(near, counted).unionByName(again.groupBy("s", "c").applyInPandas(far, counted))
    inner = inner.groupBy("s", "k").agg(F.sum("inner").alias("inner"))
    blocks = int(longest // size) + 1
    if blocks > 1:
        # for each block of places, the last touches in later blocks than each; then summed over the blocks of places before
        cells = again.groupBy("s", "b", "c").agg(F.count(F.lit(1)).alias("n"))
        spread = cells.groupBy("s", "b").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("row"))  # at most ``blocks`` entries
        later = F.reverse(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")), lambda c: F.coalesce(F.try_element_at("row", c), F.lit(0))))
        flat = spread.select("s", "b", F.posexplode(later).alias("back", "n")).withColumn("c", F.lit(blocks - 1) - F.col("back"))
        along = flat.withColumn("after", F.sum("n").over(Window.partitionBy("s", "b").orderBy("back").rowsBetween(Window.unboundedPreceding, -1)))
        before = Window.partitionBy("s", "c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        whole = along.withColumn("whole", F.sum("after").over(before)).select("s", "b", "c", "whole")
        inner = again.join(inner, ["s", "k"]).join(whole, ["s", "b", "c"], "left").select("s", "k", (F.col("inner") + F.coalesce("whole", F.lit(0))).alias("inner"))
    out = seen.join(inner, ["s", "k"], "left")
    return out.select(F.col("s").alias(stream), F.col("pos").alias(pos), F.col("ref").alias(ref), F.coalesce(F.col("k") - F.col("p") - F.col("inner"), F.lit(0)).cast("int").alias("sd"))


def stack_distance_joined(trace: DataFrame, pos: str = "pos", ref: str = "ref") -> DataFrame:
    """The same of one stream as a plain query: count last touches between two touches. Quadratic; for small traces."""
    w = Window.partitionBy(ref).orderBy(pos)
    marked = trace.select(pos, ref, F.lag(pos).over(w).alias("before"), F.lead(pos).over(w).alias("after"))
    inner = marked.select(F.col(pos).alias("p2"), F.col("after").alias("a2"))
    # a ref's last touch before ``pos`` lies in [before, pos) if its next touch is at ``pos`` or later
    hit = marked.join(inner, (F.col("p2") >= F.col("before")) & (F.col("p2") < F.col(pos)) & (F.coalesce("a2", F.col(pos)) >= F.col(pos)), "left")
    return hit.groupBy(pos, ref).agg(F.count("p2").cast("int").alias("sd"))


def cumulative_distribution(distances: DataFrame) -> DataFrame:
    """(sd, n, cum): the share of accesses up to each distance; the window sees distinct distances only."""
    counts = distances.groupBy("sd").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("sd").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("sd", "n", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("cum"))


def sample_distance(draws: DataFrame, distribution: list[tuple[int, float]], u: str = "u") -> DataFrame:
    """Inverse-CDF draws: ``draws`` with sd, the first distance whose cumulative share is at least u."""
    steps = F.array(*[F.struct(F.lit(c).alias("cum"), F.lit(s).alias("sd")) for s, c in distribution])
    hit = F.filter(steps, lambda x: x["cum"] >= F.col(u))
    return draws.withColumn("sd", F.coalesce(F.get(hit, F.lit(0))["sd"], F.lit(distribution[-1][0])))


def generate(streams: DataFrame, refs: list[int], distribution: list[tuple[int, float]], length: int, seed: int = 0) -> DataFrame:
    """(stream, pos, ref): a trace for each row of ``streams`` (stream) that has the given distances; sequential by nature,
    so one task for each stream."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in part["stream"]:
            rng = np.random.default_rng([seed, int(s)])
            stack = list(reversed(refs))  # the most recent stands last
            fresh = list(refs)
            cums = np.array([c for _, c in distribution])
            for k in range(length):
                sd = distribution[min(int(np.searchsorted(cums, rng.random())), len(distribution) - 1)][0]
                if sd == 0 and fresh:
                    r = fresh.pop(0)
                    stack.remove(r)
                else:
                    r = stack.pop(-min(max(sd, 1), len(stack)))
                stack.append(r)
                out.append((s, k, r))
        return pd.DataFrame(out, columns=["stream", "pos", "ref"])

    return streams.select("stream").groupBy("stream").applyInPandas(run, "stream bigint, pos bigint, ref bigint")


