"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors of integers are dealt to shards of a fixed average size. A shard's index has for each dimension a
posting list in descending order of impact, the absolute value. A query visits the posting segments of all
dimensions in descending impact, one level of |weight x impact| after another, and adds them up. After each level an
unvisited posting can change a score by less than the level, or than its dimension's highest impact, so each vector's score
is known within the sum of these over its unvisited dimensions, and the rounding of the sums; vectors whose upper bound is below the k-th lower bound are
out by proof. When few are left, or all postings are visited, those that may be members are scored exactly. Shards give
their best k for each query, and those meet by query.

The queries are split to blocks, and each shard is followed by the blocks that it answers in one stream: its index is made
once for up to SLICE blocks and only a block at a time is held beside it. Nothing is broadcast, and no row is made for a
pair of vectors.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, and neither does a row with
a null id; an empty vector has score 0 with all; of vectors of different lengths the shorter count as filled up with zeros;
rows with equal ids are candidates one by one, but not of each other; ties go to the smaller id; a component of 2**62 or
more after scaling, or a score beyond 64 bits, is an error; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Vectors of a shard and queries of a block, on average, and blocks that follow one copy of a shard at most.
SHARD, BLOCK, SLICE = 1 << 15, 256, 64
RESULT = "query_id long, vec_id long, score long"
_ROWS = "part int, ids binary, dims int, x binary"


def integers(vectors: DataFrame, column: str, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the vectors that take part; each component is floor(scale * x), x as double."""

    def whole(c: Column) -> Column:
        x = c.cast("double")
        none = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        far = F.raise_error(F.concat(F.lit("a component is too large: "), x.cast("string"))).cast("bigint")
        return F.when(none, F.lit(None)).when(F.abs(x * scale) < (1 << 62), F.floor(x * scale)).otherwise(far)

    found = vectors.filter("vec_id is not null").select("vec_id", F.transform(column, whole).alias("v"))
    return found.filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull()))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _blob(key, table):
    ids = np.array(table.column("vec_id").to_pylist(), np.int64)
    x = _matrix(table.column("v").to_pylist())
    order = np.argsort(ids, kind="stable")
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "dims": pa.array([x.shape[1]], pa.int32()), "x": pa.array([x[order].astype("<i8").tobytes()], pa.binary())})


def products(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``weight``; in whole numbers of any size where 64 bits may not do."""
    largest = [max(int(v.max(initial=0)), -int(v.min(initial=0))) for v in (x, weight)]
    if largest[0] * largest[1] * max(1, len(weight)) < 1 << 63:
        return x @ weight
    out = [sum(int(a) * int(b) for a, b in zip(row, weight, strict=True)) for row in x]
    if any(abs(v) >= 1 << 63 for v in out):
        raise OverflowError("a score is beyond 64 bits")
    return np.array(out, np.int64)


class Shard:
    """The index of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        size = np.abs(x)
        self.order = np.argsort(-size, axis=0, kind="stable").T.copy()
        self.impact = -np.take_along_axis(size, self.order.T, 0).T  # ascending, as negatives, for searchsorted
        self.value = np.take_along_axis(x, self.order.T, 0).T.astype(np.float64)
        self.visited = self.postings = 0

    def search(self, query: np.ndarray, own: int, k: int, step: float = 0.25) -> list[tuple[int, int]]:
        """The best k (score, id) for one query, without the vector ``own``.

        Of a dimension whose highest impact is below the level nothing has been visited, and no posting can add more than
        that impact; of the others an unvisited posting can add less than the level.
        """
        n, dims = self.x.shape
        dims = min(dims, len(query))
        weight = query[:dims]
        active = np.flatnonzero(weight)
        top = np.array([int(-self.impact[d, 0]) * abs(int(weight[d])) for d in active], float)
        score, seen = np.zeros(n), np.zeros(n)
        here = self.ids != own
        at = np.zeros(dims, np.int64)
        level = highest = float(top.max(initial=0))
        rounding = 2.0 * len(active) * len(active) * highest * 2.0**-52  # of sums of so many terms, each rounded as well
        maybe = np.flatnonzero(here)
        self.postings += n * len(active)
        while level > 0.5 and len(maybe) > max(16 * k, n // 4):  # beyond that, scoring the rest exactly is the shorter way
            level = level * step if level > 1 else 0.5
            docs, add = [], []
            for d in active:
                to = int(np.searchsorted(self.impact[d], -level / abs(int(weight[d])), side="right"))
                if to > at[d]:
                    docs.append(self.order[d, at[d] : to])
                    add.append(self.value[d, at[d] : to] * float(weight[d]))
                    at[d] = to
            if not docs:
                continue
            docs_, add_ = np.concatenate(docs), np.concatenate(add)
            self.visited += len(docs_)
            score += np.bincount(docs_, add_, n)
            seen += np.bincount(docs_, minlength=n)
            open_ = top >= level
            slack = level * (int(open_.sum()) - seen) + (float(top[~open_].sum()) + rounding)
            low = (score - slack)[here]
            if len(low) > k:
                best = np.partition(low, len(low) - k)[len(low) - k]  # k vectors have this much at least
                maybe = np.flatnonzero(here & (score + slack >= best))
        exact = products(self.x[maybe, :dims], weight)
        found = np.lexsort((self.ids[maybe], -exact))[:k]
        return [(int(exact[i]), int(self.ids[maybe[i]])) for i in found]


def _search(k: int):
    """Rows (part, slice, kind, ids, dims, x): a shard (kind 0) and then the blocks of queries that it answers (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for r in range(batch.num_rows):
                kind, ids, dims, x = (batch.column(c)[r].as_py() for c in range(2, 6))
                names = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(x, "<i8").reshape(len(names), dims)
                if kind == 0:
                    index = Shard(names, vectors)
                    continue
                rows = [(int(q), i, s) for q, v in zip(names, vectors, strict=True) for s, i in index.search(v, int(q), k)]
                columns = zip(*rows, strict=True) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _parts(vectors: DataFrame, size: int, n: int) -> tuple[DataFrame, int]:
    """(part, ids, dims, x), one row for about ``size`` vectors. ``vectors``: checkpointed, so the draw is the same again."""
    count = max(1, -(-n // size))
    dealt = vectors.withColumn("part", F.floor(F.rand(5) * count).cast("int"))
    return dealt.groupBy("part").applyInArrow(_blob, _ROWS), count


def search(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that ``is_query`` names (by vec_id) the best k of all others."""
    usable = cut(integers(vectors, column, scale))
    queries = cut(usable.filter(is_query))
    shards, n_shards = _parts(usable, SHARD, usable.count())
    blocks, n_blocks = _parts(queries, BLOCK, queries.count())
    # fewer blocks to a copy of a shard only where there are too few shards for all cores
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-n_blocks // SLICE), min(n_blocks, -(-2 * cores // n_shards)))
    copies = cut(shards).select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "ids", "dims", "x")
    sent = cut(blocks).select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("to"), F.pmod("part", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "ids", "dims", "x")
    both = copies.unionByName(sent.withColumnRenamed("to", "part"))
    stream = both.repartition(min(n_shards * slices, 1 << 14), "part", "slice").sortWithinPartitions("part", "slice", "kind")
    best = map_arrow(stream.select("part", "slice", "kind", "ids", "dims", "x"), _search(k), RESULT)
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB by scoring every pair, in whole numbers.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
