"""Optimizer steps as joins: gradients are added up by id, then applied to the rows that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.operators.lookup import pool


def coalesced(gradients: DataFrame, dim: int) -> DataFrame:
    """(id, grad): the sum of all gradients (id, grad) of an id, before anything is applied."""
    return pool(gradients.select("id", F.col("grad").alias("vec")), dim, key="id").withColumnRenamed("vec", "grad")


def sgd(table: DataFrame, gradients: DataFrame, rate: float, dim: int) -> DataFrame:
    """(id, vec) after one step."""
    both = table.join(coalesced(gradients, dim), "id", "left")
    step = F.zip_with("vec", "grad", lambda w, g: w - rate * g)
    return both.withColumn("vec", F.when(F.col("grad").isNull(), F.col("vec")).otherwise(step)).drop("grad")


def adagrad(table: DataFrame, gradients: DataFrame, rate: float, dim: int, eps: float = 1e-10) -> DataFrame:
    """(id, vec, state ARRAY): a running sum of squares for each component."""
    both = table.join(coalesced(gradients, dim), "id", "left")
    state = F.zip_with("state", "grad", lambda s, g: s + g * g)
    both = both.withColumn("state", F.when(F.col("grad").isNull(), F.col("state")).otherwise(state))
    move = F.zip_with("grad", "state", lambda g, s: rate * g / (F.sqrt(s) + eps))
    return both.withColumn("vec", F.when(F.col("grad").isNull(), F.col("vec")).otherwise(F.zip_with("vec", move, lambda w, m: w - m))).drop("grad")


def rowwise_adagrad(table: DataFrame, gradients: DataFrame, rate: float, dim: int, step: int = 1, decay: float = 0.0, eps: float = 1e-10) -> DataFrame:
    """(id, vec, momentum): momentum grows by the mean square of the row's whole gradient; w -= rate g / (sqrt(m) + eps)."""
    now = rate / (1 + (step - 1) * decay)
    both = table.join(coalesced(gradients, dim), "id", "left")
    mean = F.aggregate("grad", F.lit(0.0), lambda s, g: s + g * g) / dim
    both = both.withColumn("momentum", F.col("momentum") + F.coalesce(mean, F.lit(0.0)))
    moved = F.zip_with("vec", "grad", lambda w, g: w - now * g / (F.sqrt(F.col("momentum")) + eps))
    return both.withColumn("vec", F.when(F.col("grad").isNull(), F.col("vec")).otherwise(moved)).drop("grad")


def train_logistic(batches: list[DataFrame], weights: list[float], rate: float, every: int = 1) -> tuple[list[float], list[float]]:
    """A loop of full steps over batches (x ARRAY, y): the model's weights and the loss at each ``every``-th batch.

    Only the gradient, as long as the model, comes to the driver.
    """
    from recframe.functions.scalar import dot
    from recframe.operators.metrics import bce

    history = []
    for k, batch in enumerate(batches):
        p = 1 / (1 + F.exp(-dot(F.col("x"), F.array(*map(F.lit, weights)))))
        scored = batch.withColumn("p", p)
        row = scored.agg(F.avg(bce(F.col("p"), F.col("y"))).alias("loss"), *[F.avg((F.col("p") - F.col("y")) * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(len(weights))]).collect()[0]
        weights = [w - rate * row[f"g{i}"] for i, w in enumerate(weights)]
        if k % every == 0:
            history.append(row["loss"])
    return weights, history
