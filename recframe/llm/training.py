"""Bounded samples of labelled documents, for the models that are fitted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


#: Bytes of text that a sample holds at most.
BYTES = 1 << 26


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, size: int = BYTES) -> DataFrame:
    """(_place, doc_id, _label, text) of labelled documents outside the held-out fold, in one partition: at most ``bound``, and
    as many of the first ones by place and id as have ``size`` bytes together.

    Which documents is settled by a hash of the id alone. Rows without a label or id are left out; of several labels of
    one id the largest holds, of several texts with one id the one of the smallest hash.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(fold("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max(label).alias("_label"))
    n = known.count()
    place = F.xxhash64("doc_id", F.lit(17))
    if n > bound:  # about the bound by a threshold on the hash, then exactly
        known = known.filter(F.pmod(place, F.lit(1 << 30)) < int(1.1 * bound / n * (1 << 30)))
    chosen = known.withColumn("_place", place).orderBy("_place", "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``bound`` rows
    rows = rows.groupBy("_place", "doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    before = Window.orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over ``bound`` rows at most
    rows = rows.withColumn("_upto", F.sum(F.octet_length("text")).over(before)).filter(F.col("_upto") <= size)
    return rows.select("_place", "doc_id", "_label", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, size: int = BYTES) -> list[tuple[str, int]]:
    """(text, label) of the ``labelled_rows``, in their order."""
    rows = labelled_rows(docs, labels, label, folds, held_out, bound, size)
    return [(r["text"], int(r["_label"])) for r in sorted(rows.collect(), key=lambda r: (r["_place"], r["doc_id"]))]
