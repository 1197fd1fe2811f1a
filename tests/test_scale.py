"""Numbering, running sums and stack distances over many partitions, hot groups included, and streams against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.operators import profile, splits, trace
from recframe.streaming import streams


def test_row_numbers_of_three_million_rows(spark):
    rows = spark.range(3_000_000).select(F.xxhash64("id").alias("key"), F.md5(F.col("id").cast("string")).alias("pay"), (F.col("id") % 4).alias("day"))
    r = splits.number_rows(rows, "key").agg(F.count_distinct("row_id").alias("d"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count(F.lit(1)).alias("n")).collect()[0]
    assert tuple(r) == (3_000_000, 0, 2_999_999, 3_000_000)
    per_day = splits.shuffled(rows.filter("key % 3 <> 0"), "key", "x").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("hi")).collect()
    want = {r["day"]: r["count"] for r in rows.filter("key % 3 <> 0").groupBy("day").count().collect()}
    assert {r["day"]: r["n"] for r in per_day} == want and all(r["n"] == r["d"] == r["hi"] + 1 for r in per_day)


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("own", [True, False])
def test_running_equals_a_window(spark, how, own):
    rng = np.random.default_rng(4)
    data = [(None if k % 11 == 0 else int(min(rng.integers(0, 9), 4)), int(p), None if rng.random() < 0.1 else int(rng.integers(-5, 50))) for k, p in enumerate(rng.permutation(3000))]
    got = splits.running(spark.createDataFrame(data, "g int, part int, v int").repartition(5), [F.col("part")], {"r": F.col("v")}, ["g"], how, own).collect()
    state, want = {}, {}
    for g, p, v in sorted(data, key=lambda r: r[1]):
        old = state.get(g)
        new = old if v is None else v if old is None else (old + v if how == "sum" else max(old, v))
        state[g] = new
        want[p] = new if own else old
    assert {r["part"]: r["r"] for r in got} == {p: (0 if x is None and how == "sum" else x) for p, x in want.items()}
    empty = splits.number_rows(spark.createDataFrame([], "g int, part int"), "part")
    assert empty.count() == 0


def distances(refs):
    out = []
    for k, r in enumerate(refs):
        before = [j for j in range(k) if refs[j] == r]
        out.append(len(set(refs[before[-1] : k])) if before else 0)
    return out


@pytest.mark.parametrize("block", [3, 64, None])
def test_stack_distance_in_blocks(spark, block):
    rng = np.random.default_rng(7)
    streams_ = {0: [int(min(x, 6)) for x in rng.integers(0, 30, 300)], 1: [5] * 40, 2: [1]}
    rows = [(s, 10 * k, r) for s, refs in streams_.items() for k, r in enumerate(refs)]
    got = trace.stack_distance(spark.createDataFrame(rows, "stream int, pos int, ref int").repartition(3), block=block).orderBy("stream", "pos").collect()
    assert [r["sd"] for r in got] == [d for s in sorted(streams_) for d in distances(streams_[s])]


def test_remap_of_a_large_table_has_no_row_of_all_ids(spark):
    counts = spark.createDataFrame([(0, 5, 9), (0, 200_000, 5), (0, 3, 1)], "feature int, id bigint, cnt bigint")
    out = profile.remap(counts, spark.createDataFrame([(0, 250_000)], "feature int, n bigint"), 90)
    r = {x["is_hot"]: (x["n"], x["d"], x["hi"]) for x in out.groupBy("is_hot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new_id").alias("d"), F.max("new_id").alias("hi")).collect()}
    assert r == {True: (2, 2, 1), False: (249_998, 249_998, 249_997)}


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, int(min(rng.integers(0, 9), 3)), int(t)) for k, t in enumerate(np.sort(rng.integers(0, 40_000, 400)))]
    for part in range(4):  # a file for each micro-batch, in order of time
        spark.createDataFrame(rows[100 * part : 100 * part + 100], "event_id int, user_id int, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = streams.events_stream(spark, str(tmp_path / "in"))
    for make in (streams.sessions, streams.tumbling, lambda s: streams.access_counts(s, "user_id")):
        got = streams.drain(make(stream), f"t-{rng.integers(1 << 40)}", "complete")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make(batch).collect()))
    closed = streams.drain(streams.sessions(stream), f"t-{rng.integers(1 << 40)}").collect()
    assert set(map(tuple, closed)) < set(map(tuple, streams.sessions(batch).collect()))


def test_layer_sizes_and_widths(spark):
    from recframe.operators import model

    assert model.layer_sizes("13-512-64", 13, 64) == [13, 512, 64]
    for bad in ("", "4-", "4-x", "4-0"):
        with pytest.raises(ValueError):
            model.layer_sizes(bad)
    with pytest.raises(ValueError, match="ends"):
        model.layer_sizes("4-3", 4, 2)
    # the smallest shape: tables of 4 and 3 rows, width 2, one row without ids
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "row_id int, dense array<double>")
    bags = spark.createDataFrame([(0, 0, 1), (0, 0, 3), (0, 1, 2)], "row_id int, feature int, id int")
    tables = spark.createDataFrame([(f, i, [float(i), f + 1.0]) for f, n in ((0, 4), (1, 3)) for i in range(n)], "feature int, id int, vec array<double>")
    one = [([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])]
    top = [([[0.1, 0.2, 0.3, -0.1, 0.05]], [0.0])]
    got = {r["row_id"]: r["p"] for r in model.forward(rows, bags, tables, [0, 1], 2, one, top).collect()}
    x = np.array([1.0, 2.0]), np.array([4.0, 2.0]), np.array([2.0, 2.0])
    z = [*x[0], x[1] @ x[0], x[2] @ x[0], x[2] @ x[1]]
    assert np.isclose(got[0], 1 / (1 + np.exp(-np.dot(z, top[0][0][0])))) and np.isclose(got[1], 1 / (1 + np.exp(-0.05)))
    with pytest.raises(ValueError):
        model.forward(rows, bags, tables, [0, 1], 2, one, [([[0.1]], [0.0])])
