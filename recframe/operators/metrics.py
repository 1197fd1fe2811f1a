"""Losses and classifier metrics of rows (p, y[, w])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.functions.scalar import score_class
from recframe.operators.splits import running


def _term(x: Column) -> Column:
    """A logarithm, not below -100."""
    return F.greatest(F.coalesce(F.ln(x), F.lit(-100.0)), F.lit(-100.0))


def bce(p: Column, y: Column) -> Column:
    return -(y * _term(p) + (1 - y) * _term(1 - p))


def losses(rows: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(mse, bce, wbce): means; the weighted one is the mean of w x loss, not divided by the sum of weights."""
    p, y = F.col("p"), F.col("y").cast("double")
    w = F.when(y == 1, weights[1]).otherwise(weights[0])
    return rows.agg(F.avg((p - y) * (p - y)).alias("mse"), F.avg(bce(p, y)).alias("bce"), F.avg(w * bce(p, y)).alias("wbce"))


def scaled_square_error(p: Column, y: Column, scale: float) -> Column:
    """The static graph's mean square error by row: half the squared distance, times twice the scale."""
    return 2 * scale * 0.5 * (p - y) * (p - y)


def log_loss(rows: DataFrame, eps: float = 1e-15) -> DataFrame:
    p, y = F.greatest(F.lit(eps), F.least(F.col("p"), F.lit(1 - eps))), F.col("y")
    return rows.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def classification(rows: DataFrame) -> DataFrame:
    """(n, accuracy, recall, precision, f1) of classes by rounding half to even; 0/0 is 0."""
    hit, real = score_class(F.col("p")), F.col("y").cast("int")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((hit == 1) & (real == 1)).alias("tp"),
        F.count_if((hit == 1) & (real == 0)).alias("fp"),
        F.count_if((hit == 0) & (real == 1)).alias("fn"),
        F.count_if(hit == real).alias("right"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("n", _ratio(F.col("right"), F.col("n")).alias("accuracy"), _ratio(tp, tp + fn).alias("recall"), _ratio(tp, tp + fp).alias("precision"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(rows: DataFrame) -> DataFrame:
    """One row for each distinct score: positives and negatives. All that ranking metrics need."""
    return rows.groupBy("p").agg(F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """(auc): exact, ties count a half; NULL if there is one class only.

    The running sum goes over distinct scores, in ranges of them.
    """
    run = running(_by_score(rows), [F.col("p")], {"below": F.col("neg")}, own=False)
    sums = run.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pairs = F.col("pos") * F.col("neg")
    return sums.select(F.when(pairs > 0, F.col("u") / F.nullif(pairs, F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(ap): the sum over falling distinct scores of the gain in recall times the precision."""
    run = running(_by_score(rows), [-F.col("p")], {"tp": F.col("pos"), "fp": F.col("neg")})
    sums = run.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("pos").alias("pos"))
    return sums.select(F.when(F.col("pos") > 0, F.col("s") / F.nullif(F.col("pos"), F.lit(0))).alias("ap"))


def or_sentinel(metric: Column) -> Column:
    """-1 where a metric is undefined, as the second framework reports it."""
    return F.coalesce(metric, F.lit(-1.0))


def running_loss(batches: DataFrame, every: int) -> DataFrame:
    """(print_id, loss, samples) of rows (batch_id, loss, samples): means weighted by batch size, anew after each print."""
    window = F.floor(F.col("batch_id") / every).alias("print_id")
    return batches.groupBy(window).agg((F.sum(F.col("loss") * F.col("samples")) / F.sum("samples")).alias("loss"), F.sum("samples").alias("samples"))
