"""Feature interaction and multi-layer scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.functions.scalar import dot


def dot_interaction(features: list[Column], with_self: bool = False) -> Column:
    """The first feature, then the dot products of each pair (i, j), j < i (j <= i ``with_self``), row by row."""
    pairs = [dot(features[i], features[j]) for i in range(len(features)) for j in range(i + with_self)]
    return F.concat(features[0], F.array(*pairs))


def cat_interaction(features: list[Column]) -> Column:
    return F.concat(*features)


def interaction_width(features: int, dim: int, how: str = "dot", with_self: bool = False) -> int:
    if how == "cat":
        return features * dim
    return features * (features + (1 if with_self else -1)) // 2 + dim


def check_width(top_input: int, features: int, dim: int, how: str = "dot", with_self: bool = False) -> None:
    if top_input != (width := interaction_width(features, dim, how, with_self)):
        raise ValueError(f"the top layers take {top_input} inputs, the interaction has {width}")


def low_rank_cross(x: Column, base: Column, layers: list[tuple[list[list[float]], list[list[float]], list[float]]]) -> Column:
    """Cross layers of low rank: x' = base * (W (V x) + b) + x, for each (V, W, b)."""
    for v, w, bias in layers:
        low = F.array(*[dot(x, F.array(*map(F.lit, row))) for row in v])
        high = F.array(*[dot(low, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(w, bias, strict=True)])
        x = F.zip_with(F.zip_with(base, high, lambda p, q: p * q), x, lambda p, q: p + q)
    return x


def projected_interaction(features: list[Column], left: list[list[float]], right: list[list[float]]) -> Column:
    """Dot products of two learned mixtures of the features: the first feature, then (left F) . (right F) row by row."""

    def mixed(rows: list[list[float]]) -> list[Column]:
        out = []
        for row in rows:
            terms = [F.transform(f, lambda x, c=c: x * F.lit(c)) for f, c in zip(features, row, strict=True)]
            acc = terms[0]
            for t in terms[1:]:
                acc = F.zip_with(acc, t, lambda p, q: p + q)
            out.append(acc)
        return out

    return F.concat(features[0], F.array(*[dot(a, b) for a in mixed(left) for b in mixed(right)]))


Layer = tuple[list[list[float]], list[float]]


def mlp(x: Column, layers: list[Layer], sigmoid_at: int = -1) -> Column:
    """Linear layers with ReLU after each, or a sigmoid after layer ``sigmoid_at``; for narrow layers."""
    for k, (weights, bias) in enumerate(layers):
        z = F.array(*[dot(x, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(weights, bias, strict=True)])
        x = F.transform(z, (lambda v: 1 / (1 + F.exp(-v))) if k == sigmoid_at else (lambda v: F.greatest(v, F.lit(0.0))))
    return x


def mlp_wide(rows: DataFrame, column: str, layers: list[Layer], sigmoid_at: int = -1, out: str = "score") -> DataFrame:
    """The same for wide layers: the matrices go to each task once and Arrow batches are multiplied as a whole."""
    matrices = [(np.array(w, float).T, np.array(b, float)) for w, b in layers]
    sent = rows.sparkSession.sparkContext.broadcast(matrices)  # the model's size, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            x = np.asarray(values.flatten(), float).reshape(batch.num_rows, -1)
            for k, (w, b) in enumerate(sent.value):
                z = x @ w + b
                x = 1 / (1 + np.exp(-z)) if k == sigmoid_at else np.maximum(z, 0)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1])
            scores = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` array<double>")
