"""Hand-checked cases."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recframe.functions import scalar as fx
from recframe.operators import dictionary, interact, lookup, metrics, optim, profile, quantize, splits, synth, trace
from recframe.plans import layout
from recframe.sources import clicks


def one(df):
    return df.collect()[0][0]


def test_stack_distances_two_ways(spark):
    refs = [1, 2, 3, 4, 5, 3, 4, 1, 1, 6, 3]
    rows = spark.createDataFrame([(0, k, r) for k, r in enumerate(refs)], "stream int, pos bigint, ref bigint")
    want = [0, 0, 0, 0, 0, 3, 3, 5, 1, 0, 4]
    got = trace.stack_distance(rows)
    assert [r["sd"] for r in got.orderBy("pos").collect()] == want
    assert [r["sd"] for r in trace.stack_distance_joined(rows).orderBy("pos").collect()] == want
    cdf = [(r["sd"], round(r["cum"], 2)) for r in trace.cumulative_distribution(got).orderBy("sd").collect()]
    assert cdf == [(0, 0.55), (1, 0.64), (3, 0.82), (4, 0.91), (5, 1.0)]


def test_chunks_and_halves(spark):
    rows = splits.with_total(spark.range(23).withColumnRenamed("id", "row_id"))
    sizes = rows.groupBy(splits.chunk_of(F.col("row_id"), F.col("n"), 7).alias("c")).count().orderBy("c").collect()
    assert [r["count"] for r in sizes] == [4, 4, 3, 3, 3, 3, 3]
    seven = spark.range(7).withColumn("n", F.lit(7))
    parts = seven.select(splits.last_day_halves(F.lit(1), F.lit(1), F.col("id"), F.col("n")).alias("s"), splits.streaming_validation(F.col("id"), F.col("n")).alias("v"), "id").orderBy("id").collect()
    assert [r["s"] for r in parts] == ["test"] * 4 + ["val"] * 3
    assert [r["id"] for r in parts if r["v"]] == [3, 4, 5, 6]


def test_layout_arithmetic():
    assert layout.split_sizes(10, 4) == [3, 3, 2, 2]
    sizes = list(enumerate([90, 99, 99, 99, 99, 60, 80]))
    assert layout.merge_groups(sizes, 100) == [[0, 1, 2, 3, 4, 5], [6]]
    assert layout.exclusive_sums([90, 99, 60]) == [0, 90, 189]
    assert layout.popularity_dims([4, 3, 2], 0.3, 2) == [2, 2, 2]
    with pytest.raises(ValueError):
        layout.LayoutConfig(num_splits=0)
    plan = layout.plan([(0, 5), (1, 50), (2, 60), (3, 5000), (4, 700)], layout.LayoutConfig(merge_below=100, tiny_below=10, split_from=1000, split_to=9999, num_splits=2))
    assert plan == [(0, "tiny", 1, 0, 5), (1, "merge", 0, 0, 50), (2, "merge", 0, 50, 60), (3, "split", 2, 0, 2500), (3, "split", 3, 2500, 2500), (4, "medium", 4, 0, 700)]


def test_hot_set_and_remap(spark):
    counts = spark.createDataFrame([(0, 7, 5), (0, 2, 3), (0, 9, 1), (0, 4, 1)], "feature int, id bigint, cnt bigint")
    assert {r["id"] for r in profile.hot_ids(counts, 80).collect()} == {7, 2}
    assert profile.coverage(counts, 80).collect()[0]["covered"] == 80.0
    sizes = spark.createDataFrame([(0, 10)], "feature int, n bigint")
    rows = {r["id"]: (r["is_hot"], r["new_id"]) for r in profile.remap(counts, sizes, 80).collect()}
    assert rows[2] == (True, 0) and rows[7] == (True, 1)
    assert [rows[k] for k in (0, 1, 3, 4, 5, 6, 8, 9)] == [(False, k) for k in range(8)]


def test_dictionaries(spark):
    rows = spark.createDataFrame([(k, 0, v) for k, v in enumerate("babca")], "row_id bigint, feature int, raw string")
    assert {r["raw"]: r["code"] for r in dictionary.first_seen(rows, "row_id").collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r["raw"]: r["code"] for r in dictionary.sorted_codes(rows).collect()} == {"a": 0, "b": 1, "c": 2}
    codes = dictionary.first_seen(rows.filter("raw <> 'c'"), "row_id")
    with pytest.raises(Exception, match="no code"):
        dictionary.encode(rows, codes).collect()
    assert dictionary.encode(rows, codes, strict=False).filter("code IS NULL").count() == 1


def test_fields(spark):
    row = spark.createDataFrame([("", "0", "ffffffff", -3.0, 0.0, 1.0)], "a string, b string, c string, x double, y double, z double")
    r = row.select(
        fx.missing_to_zero(F.col("a")), fx.missing_to_zero(F.col("b")), fx.hex_to_int(F.col("c")), fx.dense_log(F.col("x")), fx.dense_log(F.col("y")), fx.dense_log(F.col("z")), *[fx.score_class(F.lit(v)) for v in (0.5, 1.5, 2.5)], fx.score_class_half_up(F.lit(0.5))
    ).collect()[0]
    assert list(r)[:3] == ["0", "0", 4294967295] and r[3] == 0 and r[4] == 0 and math.isclose(r[5], math.log(2))
    assert list(r)[6:] == [0, 2, 2, 1]


def test_offsets(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 5)], "k int, off bigint")
    w = Window.orderBy("k")
    assert [r[0] for r in rows.select(fx.offsets_to_lengths(F.col("off"), F.lit(6), w), "k").orderBy("k").collect()] == [2, 0, 3, 1]
    back = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "k int, n bigint")
    assert [r[0] for r in back.select(fx.lengths_to_offsets(F.col("n"), w), "k").orderBy("k").collect()] == [0, 2, 2, 5]


def test_quotient_remainder_combines_after_pooling(spark):
    bags = spark.createDataFrame([(0, 0), (0, 3)], "row_id bigint, id bigint")
    q = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id bigint, vec array<double>")
    r = spark.createDataFrame([(0, [3.0]), (1, [4.0])], "id bigint, vec array<double>")
    assert lookup.quotient_remainder(bags, q, r, 2, 1, "mult").collect()[0]["vec"] == [21.0]


def test_interaction_order(spark):
    v = [F.array(F.lit(float(k)), F.lit(1.0)) for k in (1, 2, 3)]
    row = spark.range(1).select(interact.dot_interaction(v).alias("z"), interact.dot_interaction(v, True).alias("s")).collect()[0]
    assert row["z"] == [1.0, 1.0, 3.0, 4.0, 7.0] and row["s"] == [1.0, 1.0, 2.0, 3.0, 5.0, 4.0, 7.0, 10.0]
    assert interact.interaction_width(3, 2) == 5 and interact.interaction_width(3, 2, with_self=True) == 8
    with pytest.raises(ValueError):
        interact.check_width(4, 3, 2)


def test_quantize_bounds(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [-1.0, 0.3])], "id bigint, vec array<double>")
    q = {r["id"]: r for r in quantize.quantize_rows(rows).collect()}
    assert q[0]["q"] == [0, 255] and math.isclose(q[0]["scale"], 1 / 255) and q[1]["scale"] == 1.0
    e = quantize.errors(rows.filter("id <> 1"), quantize.dequantize(quantize.quantize_rows(rows))).collect()[0]
    assert e["max_error"] <= 1.3 / 255
    assert quantize.quantize_global(rows.filter("id = 1")).collect()[0]["scale"] == 1.0
    packed = rows.filter("id = 0").select(quantize.packed_nibbles(F.array(F.lit(1), F.lit(2), F.lit(3)))).collect()[0][0]
    assert packed == [33, 3]


def test_undefined_metrics(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, y int")
    assert metrics.roc_auc(rows).collect()[0]["auc"] is None
    assert metrics.roc_auc(rows).select(metrics.or_sentinel(F.col("auc"))).collect()[0][0] == -1.0
    c = metrics.classification(rows).collect()[0]
    assert (c["recall"], c["precision"], c["f1"], c["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_auc_is_the_pair_count(spark):
    import itertools

    rows = [((k * 37 % 11) / 10, k * k % 3 == 1) for k in range(60)]
    df = spark.createDataFrame([(p, int(y)) for p, y in rows], "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / len(pos) / len(neg)
    assert math.isclose(metrics.roc_auc(df).collect()[0]["auc"], want)


def test_drift(spark):
    rows = spark.createDataFrame(list(enumerate("aaba")), "row_id bigint, v string")
    r = profile.drift(rows, spark.createDataFrame([(2,)], "cut bigint"), "v").collect()[0]
    assert (r["before"], r["after"], r["both"], r["removed"]) == (1, 2, 1, 0)


def test_learning_rate(spark):
    steps = spark.createDataFrame([(k,) for k in (1, 3, 4, 5, 6, 7, 9)], "s bigint")
    got = [r[0] for r in steps.select(fx.warm_up_then_decay(F.col("s"), 1.0, 4, 6, 2), "s").orderBy("s").collect()]
    assert got == [0.25, 0.75, 0.75, 0.75, 1.0, 0.25, 0.25]


def test_row_numbers_are_consecutive(spark):
    rows = splits.number_rows(spark.range(0, 1000, 3).repartition(7), "id")
    assert rows.filter("row_id * 3 <> id").count() == 0 and rows.count() == 334


def test_shuffle_keeps_rows_and_day_sizes(spark):
    rows = spark.range(101).select("id", (F.col("id") % 4).alias("day"))
    out = splits.shuffled(rows, "id", "s")
    assert sorted(r["id"] for r in out.collect()) == list(range(101))
    assert {r["day"]: r["count"] for r in out.groupBy("day").count().collect()} == {r["day"]: r["count"] for r in rows.groupBy("day").count().collect()}
    assert {r["id"] for r in out.filter("day = 3").collect()} == {r["id"] for r in rows.filter("day = 3").collect()}


def test_duplicate_gradients_are_added_first(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0], 0.0), (1, [1.0, 1.0], 0.0)], "id bigint, vec array<double>, momentum double")
    grads = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 2.0])], "id bigint, grad array<double>")
    r = {x["id"]: x for x in optim.rowwise_adagrad(table, grads, 1.0, 2, eps=0.0).collect()}
    assert r[0]["momentum"] == 4.0 and r[0]["vec"] == [0.0, 0.0] and r[1]["vec"] == [1.0, 1.0]


def test_training_goes_down(spark):
    batch = spark.createDataFrame([([1.0, float(k % 2)], k % 2) for k in range(20)], "x array<double>, y int")
    weights, history = optim.train_logistic([batch] * 5, [0.0, 0.0], 1.0)
    assert history[-1] < history[0] and weights[1] > 0


def test_records_round_trip(spark):
    rows = spark.createDataFrame([(k, k % 2, list(range(13)), [4294967295 - k] + [k] * 25) for k in range(10)], "row_id bigint, y int, dense array<int>, sparse array<bigint>")
    blocks = clicks.to_records(rows, 4)
    assert sorted(map(tuple, clicks.from_records(blocks).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert clicks.record_at(blocks, 6, 4).collect()[0]["sparse"][0] == 4294967289


def test_sources(spark, tmp_path):
    line = "\t".join(["1"] + ["5"] * 12 + [""] + ["0000000a"] * 25 + [""])
    (tmp_path / "raw").mkdir()
    for day in range(2):
        (tmp_path / "raw" / f"day_{day}").write_text(line + "\n" + line.replace("1", "0", 1) + "\n")
    parsed = clicks.parse(clicks.with_day(clicks.read_raw(spark, f"{tmp_path}/raw")), clicks.EtlConfig(max_ind_range=7))
    rows = parsed.orderBy("day", "y").collect()
    assert [r["day"] for r in rows] == [0, 0, 1, 1] and rows[0]["dense"][-1] == 0 and rows[0]["sparse"] == [3] * 25 + [0]
    clicks.write_days(parsed, f"{tmp_path}/out")
    clicks.write_days(parsed.limit(0), f"{tmp_path}/out")  # there already: used as it is
    assert clicks.load(spark, f"{tmp_path}/out", "train", 1).count() == 2
    (tmp_path / "trace").write_text("1, 18446744073709551615, 3\n")
    assert [int(r["ref"]) for r in clicks.read_trace(spark, f"{tmp_path}/trace").orderBy("pos").collect()] == [1, 2**64 - 1, 3]
    clicks.write_distribution(spark, f"{tmp_path}/dist", [1, 2], [(0, 0.5), (3, 1.0)])
    assert clicks.read_distribution(spark, f"{tmp_path}/dist") == ([1, 2], [(0, 0.5), (3, 1.0)])
    clicks.save_checkpoint(spark, f"{tmp_path}/ck", {"emb": parsed.select("y")}, {"epoch": 1, "iter": 4})
    tables, state = clicks.load_checkpoint(spark, f"{tmp_path}/ck", ["emb"])
    assert tables["emb"].count() == 4 and clicks.resume_at(state, 5) == (2, 0)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("peak = 3.5\nother\npeak = 4.5\ntotal: 10\n")
    run = clicks.parse_runs(clicks.numbered_lines(spark, f"{tmp_path}/logs"), {"peak": "peak", "total": "total"}).collect()[0]
    assert (run["peak"], run["total"]) == (4.5, 10.0)


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = synth.uniform_bags(spark, 50, [5, 50], 4, seed=3)
    b = synth.uniform_bags(spark, 50, [5, 50], 4, seed=3).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert all(0 < len(r["ids"]) <= 4 and r["ids"] == sorted(set(r["ids"])) and r["ids"][-1] < (5, 50)[r["feature"]] for r in a.collect())
    g = synth.gaussian_bags(spark, 50, [5], 4, -1, 1)
    assert all(0 <= x < 5 for r in g.collect() for x in r["ids"])
