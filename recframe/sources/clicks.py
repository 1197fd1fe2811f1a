"""Click logs and everything that is stored of them.

A raw log is tab-separated text: a label, 13 decimal counts and 26 hexadecimal categories; a field may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.functions.scalar import dense_log, hash_cap, hex_to_int, keep_after_subsampling, missing_to_zero

DENSE, SPARSE = 13, 26
RAW = T.StructType([T.StructField(n, T.StringType()) for n in ["label", *[f"i{k}" for k in range(1, DENSE + 1)], *[f"c{k}" for k in range(1, SPARSE + 1)]]])


@dataclass(frozen=True)
class EtlConfig:
    """How a log is read: ``max_ind_range`` folds ids, ``sub_sample_rate`` drops negatives; both off at 0."""

    max_ind_range: int = 0
    sub_sample_rate: float = 0.0
    dense: int = DENSE
    sparse: int = SPARSE

    def __post_init__(self):
        if not 0 <= self.sub_sample_rate <= 1 or self.max_ind_range < 0:
            raise ValueError("a rate lies between 0 and 1, a range isn't negative")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One file, a folder or a pattern of day files, with the file each row came from."""
    return spark.read.csv(path, sep="\t", schema=RAW).withColumn("file", F.input_file_name())


def with_day(raw: DataFrame, pattern: str = r"day_(\d+)") -> DataFrame:
    return raw.withColumn("day", F.regexp_extract("file", pattern, 1).cast("int"))


def parse(raw: DataFrame, config: EtlConfig = EtlConfig(), key: str | None = None) -> DataFrame:
    """(other columns, y, dense ARRAY<INT>, sparse ARRAY<BIGINT>) of raw fields label, i1.., c1..

    Missing fields are 0 in both kinds. The cap folds the unsigned value, before any narrowing. Subsampling drops
    negatives by a digest of ``key``.
    """
    own = {"label", *[f"i{k}" for k in range(1, config.dense + 1)], *[f"c{k}" for k in range(1, config.sparse + 1)]}
    out = raw.select(
        *[c for c in raw.columns if c not in own],
        missing_to_zero(F.col("label")).cast("int").alias("y"),
        F.array(*[missing_to_zero(F.col(f"i{k}")).cast("int") for k in range(1, config.dense + 1)]).alias("dense"),
        F.array(*[hash_cap(hex_to_int(missing_to_zero(F.col(f"c{k}"))), config.max_ind_range) for k in range(1, config.sparse + 1)]).alias("sparse"),
    )
    if config.sub_sample_rate and key:
        out = out.filter(keep_after_subsampling(F.col("y"), F.col(key), config.sub_sample_rate))
    return out


def model_ready(parsed: DataFrame) -> DataFrame:
    """The counts as log(x + 1) of clamped values, the label as a float."""
    return parsed.withColumn("dense", F.transform("dense", dense_log)).withColumn("y", F.col("y").cast("float"))


def long_ids(parsed: DataFrame, row: str) -> DataFrame:
    """(row, feature, raw): one row for each category field."""
    return parsed.select(row, F.posexplode("sparse").alias("feature", "raw"))


def encoded_arrays(encoded: DataFrame, row: str) -> DataFrame:
    """(row, sparse ARRAY) of encoded fields (row, feature, code), in the order of features."""
    cells = F.array_sort(F.collect_list(F.struct("feature", "code")))
    return encoded.groupBy(row).agg(F.transform(cells, lambda x: x["code"]).alias("sparse"))


def write_days(rows: DataFrame, path: str, mode: str = "ignore") -> None:
    """Parquet by day. With ``ignore`` a folder that is there already is used as it is."""
    rows.write.mode(mode).partitionBy("day").parquet(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built and written first if it isn't there."""
    build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, split: str, last_day: int) -> DataFrame:
    """Train or the last day of a folder by day: only the files of those days are read."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("day") < last_day if split == "train" else F.col("day") == last_day)


# Fixed-width records: label, counts and categories as little-endian int32


def to_records(rows: DataFrame, block: int = 4096) -> DataFrame:
    """(first_row, n, data) of rows (row_id, y, dense, sparse): ``block`` records to a binary value, in row order."""
    width = 1 + DENSE + SPARSE

    def pack(key, table):
        order = np.argsort(np.asarray(table.column("row_id")))
        cells = np.concatenate([np.asarray(table.column("y")).reshape(-1, 1), np.array(table.column("dense").to_pylist()).reshape(table.num_rows, -1), np.array(table.column("sparse").to_pylist()).reshape(table.num_rows, -1)], 1)
        data = (cells[order].astype(np.int64) & 0xFFFFFFFF).astype("<u4").tobytes()
        return pa.table({"first_row": pa.array([key[0].as_py() * block], pa.int64()), "n": pa.array([table.num_rows], pa.int64()), "data": pa.array([data], pa.binary()), "width": pa.array([width], pa.int32())})

    keyed = rows.select(F.expr(f"row_id div {block}").alias("block"), "row_id", "y", "dense", "sparse")
    return keyed.groupBy("block").applyInArrow(pack, "first_row long, n long, data binary, width int")


def from_records(blocks: DataFrame) -> DataFrame:
    """(row_id, y, dense, sparse) of packed blocks; categories come back as unsigned."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = np.frombuffer(data, "<i4").reshape(n, width)
                lists = [pa.array(list(cells[:, 1 : 1 + DENSE].astype(np.int32)), pa.list_(pa.int32())), pa.array(list(cells[:, 1 + DENSE :].view("<u4").astype(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(cells[:, 0].astype(np.int32)), *lists], names=["row_id", "y", "dense", "sparse"])

    return blocks.select("first_row", "n", "data", "width").mapInArrow(unpack, "row_id long, y int, dense array<int>, sparse array<long>")


def record_at(blocks: DataFrame, row: int, block: int = 4096) -> DataFrame:
    """Random access: only the block that holds the row is decoded."""
    return from_records(blocks.filter(F.col("first_row") == row // block * block)).filter(F.col("row_id") == row)


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Flat record files of other tools, each as one block."""
    files = spark.read.format("binaryFile").load(path)
    width = 1 + DENSE + SPARSE
    return from_records(files.select(F.lit(0).cast("long").alias("first_row"), (F.col("length") / (4 * width)).cast("long").alias("n"), F.col("content").alias("data"), F.lit(width).alias("width")))


# Traces, distributions, profiles, checkpoints, run logs


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(pos, ref) of one line of comma-separated numbers up to 2^64."""
    return spark.read.text(path).select(F.posexplode(F.split("value", ",")).alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), F.trim("r").cast("decimal(20,0)").alias("ref"))


def trace_lines(trace: DataFrame) -> DataFrame:
    """A trace as the line that ``read_trace`` reads."""
    return trace.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"].cast("string")), ", ").alias("value"))


def read_distribution(spark: SparkSession, path: str) -> tuple[list[int], list[tuple[int, float]]]:
    """(refs, [(distance, cumulative share)]) of a file of three lines."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()][0].strip().split("\n")
    refs, distances, shares = ([x.strip() for x in line.split(",")] for line in lines[:3])
    return [int(x) for x in refs], [(int(float(d)), float(c)) for d, c in zip(distances, shares, strict=True)]


def write_distribution(spark: SparkSession, path: str, refs: list[int], steps: list[tuple[int, float]]) -> None:
    text = "\n".join([", ".join(map(str, refs)), ", ".join(str(d) for d, _ in steps), ", ".join(repr(c) for _, c in steps)])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_checkpoint(spark: SparkSession, path: str, tables: dict[str, DataFrame], state: dict) -> None:
    """A model's tables as Parquet and its position and metrics as one JSON row."""
    import json

    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load_checkpoint(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    import json

    state = json.loads(spark.read.text(f"{path}/state").collect()[0]["value"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, state


def resume_at(state: dict, batches_per_epoch: int) -> tuple[int, int]:
    """(epoch, batch) to go on with."""
    done = state["epoch"] * batches_per_epoch + state["iter"] + 1
    return divmod(done, batches_per_epoch)


def parse_runs(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Run logs (file, value) to one row for each file: the number after each pattern, the last one if it occurs again."""
    found = [F.regexp_extract("value", rf"{p}\s*[=:]?\s*(-?[0-9]+(?:\.[0-9]+)?)", 1) for p in fields.values()]
    cells = lines.select("file", "line", *[F.nullif(f, F.lit("")).cast("double").alias(n) for n, f in zip(fields, found, strict=True)])
    return cells.groupBy("file").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line"))).alias(n) for n in fields])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; a log file is read as a whole, as its lines have an order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Scalars (run, step, name, value) appended to a table, in place of an event log."""
    metrics.write.mode("append").parquet(path)


