"""The registered queries of the library's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recframe.functions import scalar as fx
from recframe.operators import dictionary, interact, logs, lookup, metrics, model, optim, profile, quantize, splits, synth, trace
from recframe.plans import layout
from recframe.session import table
from recframe.sources import clicks
from recframe.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Inputs


def _vectors(spark, d) -> DataFrame:
    return lookup.vectors(table(spark, d, "embeddings"))


def _n_vectors(spark, d) -> int:
    return table(spark, d, "embeddings").count()


def _baskets(spark, d) -> DataFrame:
    n = _n_vectors(spark, d)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), fx.hash_cap(F.col("l_partkey"), n).alias("id"), (1 - F.col("l_discount")).alias("w"))


def _user_bags(spark, d) -> DataFrame:
    n = _n_vectors(spark, d)
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("row_id"), fx.hash_cap(F.col("user_id"), n).alias("id"))


def _digest(vec: DataFrame, key: str = "row_id") -> DataFrame:
    """Three rounded numbers of each vector: first component, sum, squared norm."""
    return vec.select(key, fx.rounded(F.get("vec", F.lit(0))).alias("first"), fx.rounded(fx.total("vec")).alias("total"), fx.rounded(fx.square_norm("vec"), 3).alias("norm2"))


_BASKETS = "b AS (SELECT l_orderkey AS row_id, l_partkey % (SELECT count(*) FROM embeddings) AS id, 1 - l_discount AS w FROM lineitem)"
_USERS = "b AS (SELECT event_id // 4 AS row_id, user_id % (SELECT count(*) FROM embeddings) AS id FROM events)"
_CELLS = "e AS (SELECT vec_id AS id, unnest(generate_series(1, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _digest_sql(cells: str, key: str = "row_id") -> str:
    """The digest of a CTE (key, i, x)."""
    return f"SELECT {key}, round(sum(CASE WHEN i = 1 THEN x ELSE 0 END), 4) + 0.0 AS first, round(sum(x), 4) + 0.0 AS total, round(sum(x * x), 3) + 0.0 AS norm2 FROM {cells} GROUP BY {key}"


def _pooled(bags: str, agg: str = "sum(x)") -> str:
    return f"WITH {bags}, {_CELLS}, p AS (SELECT row_id, i, {agg} AS x FROM b JOIN e USING (id) GROUP BY row_id, i) {_digest_sql('p')}"


# Lookups


@query(_pooled(_BASKETS))
def basket_embedding_sum(spark, d):
    return _digest(lookup.bag(_baskets(spark, d), _vectors(spark, d), DIM))


@query(_pooled(_BASKETS, "sum(x * w)"))
def bag_weighted_sum(spark, d):
    return _digest(lookup.bag(_baskets(spark, d), _vectors(spark, d), DIM, weighted=True))


@query(_pooled(_BASKETS, "avg(x)"))
def bag_mean(spark, d):
    return _digest(lookup.bag(_baskets(spark, d), _vectors(spark, d), DIM, "mean"))


@query(_pooled(_BASKETS, "max(x)"))
def bag_max(spark, d):
    return _digest(lookup.bag(_baskets(spark, d), _vectors(spark, d), DIM, "max"))


@query(_pooled(_BASKETS, "sum(x * (1 + id % 3))"))
def bag_row_weights(spark, d):
    weighted = _vectors(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return _digest(lookup.bag_with_row_weights(_baskets(spark, d), weighted, DIM))


@query(
    f"WITH b AS (SELECT o_custkey AS row_id, o_orderkey % (SELECT count(*) FROM embeddings) AS id FROM orders), {_CELLS}, "
    f"p AS (SELECT c_custkey AS row_id, i, coalesce(sum(x), 0) AS x FROM customer LEFT JOIN b ON c_custkey = b.row_id LEFT JOIN e USING (id) GROUP BY ALL) {_digest_sql('p')}"
)
def empty_bag_zero(spark, d):
    n = _n_vectors(spark, d)
    bags = table(spark, d, "orders").select(F.col("o_custkey").alias("row_id"), fx.hash_cap(F.col("o_orderkey"), n).alias("id"))
    spine = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))
    return _digest(lookup.bag(bags, _vectors(spark, d), DIM, spine=spine))


def _qr_sql(last: str) -> str:
    q = "q AS (SELECT row_id, i, sum(x) AS x FROM b JOIN e ON e.id = b.id // 16 GROUP BY row_id, i), r AS (SELECT row_id, i, sum(x) AS x FROM b JOIN e ON e.id = b.id % 16 GROUP BY row_id, i)"
    return f"WITH {_USERS}, {_CELLS}, {q}, p AS ({last}) {_digest_sql('p')}"


def _qr(spark, d, how):
    v = _vectors(spark, d)
    return _digest(lookup.quotient_remainder(_user_bags(spark, d), v, v, 16, DIM, how))


@query(_qr_sql("SELECT row_id, i, q.x * r.x AS x FROM q JOIN r USING (row_id, i)"))
def qr_lookup_mult(spark, d):
    return _qr(spark, d, "mult")


@query(_qr_sql("SELECT row_id, i, q.x + r.x AS x FROM q JOIN r USING (row_id, i)"))
def qr_lookup_add(spark, d):
    return _qr(spark, d, "add")


@query(_qr_sql("SELECT row_id, i, x FROM q UNION ALL SELECT row_id, i + 64, x FROM r"))
def qr_lookup_concat(spark, d):
    return _qr(spark, d, "concat")


@query(f"WITH {_USERS}, {_CELLS}, s AS (SELECT row_id, i, sum(x) AS x FROM b JOIN e USING (id) WHERE i <= 4 GROUP BY row_id, i), k AS (SELECT unnest(generate_series(1, 8)) AS j), p AS (SELECT row_id, j AS i, sum(x * ((j - 1) + (i - 1) - 4)) AS x FROM s, k GROUP BY row_id, j) {_digest_sql('p')}")
def mixed_dim_projection(spark, d):
    narrow = _vectors(spark, d).withColumn("vec", F.slice("vec", 1, 4))
    return _digest(lookup.projected(_user_bags(spark, d), narrow, 4, [[float(j + i - 4) for i in range(4)] for j in range(8)]))


def _features(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bags of three small features of suppliers and customers, their sizes, and their tables (rows of the embeddings)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.posexplode(F.array(F.col("c_nationkey").cast("bigint"), F.pmod(F.col("c_custkey"), F.lit(7)), F.length("c_mktsegment").cast("bigint"))).alias("feature", "id"))
    sizes = spark.createDataFrame([(0, 25), (1, 7), (2, 20)], "feature int, n bigint")
    tables = sizes.join(_vectors(spark, d), F.col("id") < F.col("n")).select("feature", "id", F.transform("vec", lambda x: x * (F.col("feature") + 1)).alias("vec"))
    return c, sizes, tables


@query(
    f"WITH {_CELLS}, c AS (SELECT c_custkey AS row_id, 0 AS feature, CAST(c_nationkey AS BIGINT) AS id FROM customer UNION ALL SELECT c_custkey, 1, c_custkey % 7 FROM customer UNION ALL SELECT c_custkey, 2, length(c_mktsegment) FROM customer), "
    "p AS (SELECT row_id, feature, i, sum(x * (feature + 1)) AS x FROM c JOIN e USING (id) GROUP BY ALL) " + _digest_sql("p", "row_id, feature")
)
def merged_lookup(spark, d):
    bags, sizes, tables = _features(spark, d)
    bases = layout.exclusive_sums([25, 7, 20])
    offsets = spark.createDataFrame(list(enumerate(bases)), "feature int, base bigint")
    out = lookup.merged(bags, offsets, lookup.concatenated(tables, offsets), DIM)
    return out.select("row_id", "feature", fx.rounded(F.get("vec", F.lit(0))).alias("first"), fx.rounded(fx.total("vec")).alias("total"), fx.rounded(fx.square_norm("vec"), 3).alias("norm2"))


@query(_pooled(_USERS))
def split_lookup(spark, d):
    return _digest(lookup.split_lookup(_user_bags(spark, d), _vectors(spark, d), _n_vectors(spark, d), 4, DIM))


def _remap(spark, d, percent=80.0) -> DataFrame:
    bags = _user_bags(spark, d).withColumn("feature", F.lit(0))
    sizes = spark.createDataFrame([(0, _n_vectors(spark, d))], "feature int, n bigint")
    return profile.remap(profile.access_counts(bags), sizes, percent)


@query(_pooled(_USERS))
def hotcold_lookup(spark, d):
    return _digest(lookup.hot_cold(_user_bags(spark, d), _vectors(spark, d), _remap(spark, d).drop("feature"), DIM))


@query(_pooled(_USERS))
def hotcold_stored_lookup(spark, d):
    remap = _remap(spark, d).drop("feature")
    bags = _user_bags(spark, d).withColumn("pos", F.lit(0))
    stored = _vectors(spark, d).join(remap, "id")
    return _digest(lookup.hot_cold_stored(lookup.stored_remap(bags, remap), stored.filter("is_hot"), stored.filter("NOT is_hot"), DIM))


@query("SELECT 'merged' AS layout, CAST(0 AS BIGINT) AS different UNION ALL SELECT 'split', 0 UNION ALL SELECT 'hotcold', 0")
def layouts_equal_base(spark, d):
    """Rows in which a layout differs from the plain lookup: none."""
    bags, v = _user_bags(spark, d), _vectors(spark, d)
    base = lookup.bag(bags, v, DIM)
    n = _n_vectors(spark, d)
    offsets = spark.createDataFrame([(0, n // 3)], "feature int, base bigint")
    one = lookup.merged(bags.withColumn("feature", F.lit(0)), offsets, lookup.concatenated(v.withColumn("feature", F.lit(0)), offsets), DIM).select("row_id", "vec")
    split = lookup.split_lookup(bags, v, n, 5, DIM)
    hot = lookup.hot_cold(bags, v, _remap(spark, d).drop("feature"), DIM)
    parts = []
    for name, other in (("merged", one), ("split", split), ("hotcold", hot)):
        gap = base.join(other.select("row_id", F.col("vec").alias("v2")), "row_id", "full").select(F.coalesce(F.aggregate(F.zip_with("vec", "v2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x)), F.lit(1.0)).alias("gap"))
        parts.append(gap.agg(F.count_if(F.col("gap") > 1e-9).alias("different")).select(F.lit(name).alias("layout"), "different"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"WITH {_USERS}, r AS (SELECT id, CAST(x.lo AS DOUBLE) AS lo, CASE WHEN x.hi > x.lo THEN (x.hi - x.lo) / 255 ELSE 1.0 END AS scale FROM (SELECT vec_id AS id, {{'lo': CAST(list_min(embedding) AS DOUBLE), 'hi': CAST(list_max(embedding) AS DOUBLE)}} AS x FROM embeddings)), "
    f"{_CELLS}, z AS (SELECT id, i, round_even((x - lo) / scale, 0) * scale + lo AS x FROM e JOIN r USING (id)), p AS (SELECT row_id, i, sum(x) AS x FROM b JOIN z USING (id) GROUP BY row_id, i) {_digest_sql('p')}"
)
def quantized_lookup(spark, d):
    return _digest(lookup.quantized_bag(_user_bags(spark, d), quantize.quantize_low(_vectors(spark, d)), DIM))


@query(
    "WITH c AS (SELECT event_id AS row_id, user_id % 97 AS id FROM events), k AS (SELECT unnest(generate_series(1, 3)) AS pos), n AS (SELECT unnest(generate_series(0, 96)) AS id), x AS (SELECT id, pos, (id * 7919 + pos * 104729) % 97 AS other FROM n, k) "
    "SELECT row_id, 0 AS pos, id FROM c UNION ALL SELECT row_id, pos, other FROM c JOIN x USING (id)"
)
def multi_hot_expand(spark, d):
    ids = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.pmod("user_id", F.lit(97)).alias("id"))
    more = spark.range(97).withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("other", F.pmod(F.col("id") * 7919 + F.col("pos") * 104729, F.lit(97)))
    return lookup.multi_hot(ids, more)


@query(
    "WITH c AS (SELECT user_id % 97 AS id FROM events), k AS (SELECT unnest(generate_series(1, 3)) AS pos), n AS (SELECT CAST(unnest(generate_series(0, 99)) AS BIGINT) AS id), x AS (SELECT id, (id * 7919 + pos * 104729) % 97 AS other FROM n, k), a AS (SELECT id FROM c UNION ALL SELECT other FROM c JOIN x USING (id)) "
    "SELECT n.id, (SELECT count(*) FROM c WHERE c.id = n.id) AS pre, (SELECT count(*) FROM a WHERE a.id = n.id) AS post FROM n"
)
def freq_pre_post(spark, d):
    ids = table(spark, d, "events").select(F.pmod("user_id", F.lit(97)).alias("id"))
    pre = profile.frequencies(ids, 100, "pre")
    return pre.join(profile.frequencies(multi_hot_expand(spark, d).select("id"), 100, "post"), "id")


@query("SELECT row_id, 'changed' AS what FROM (SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 97 = 0)")
def dataset_equal(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    b = a.withColumn("o_totalprice", F.when(F.col("row_id") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return lookup.differences(a, b, ["row_id"]).select("row_id", F.lit("changed").alias("what"))


# Profiles and layouts

_PROFILE = "a AS (SELECT user_id AS id, count(*) AS cnt FROM events GROUP BY user_id), c AS (SELECT id, cnt, sum(cnt) OVER (ORDER BY cnt DESC, id) AS cum, sum(cnt) OVER () AS total FROM a)"


def _users(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.lit(0).alias("feature"), F.col("user_id").alias("id"))


@query("SELECT 0 AS feature, user_id AS id, count(*) AS cnt FROM events GROUP BY user_id UNION ALL SELECT 1, l_partkey, count(*) FROM lineitem GROUP BY l_partkey")
def access_profile(spark, d):
    return profile.access_counts(_users(spark, d).unionByName(table(spark, d, "lineitem").select(F.lit(1).alias("feature"), F.col("l_partkey").alias("id"))))


@query(f"WITH {_PROFILE} SELECT id, cnt FROM c WHERE (cum - cnt) * 100 < total * 60")
def hot_set(spark, d):
    return profile.hot_ids(profile.access_counts(_users(spark, d)), 60).select("id", "cnt")


@query(f"WITH {_PROFILE} SELECT count(*) AS hot_size, round(max(cum) * 100.0 / max(total), 6) AS covered FROM c WHERE (cum - cnt) * 100 < total * 60")
def hot_coverage(spark, d):
    return profile.coverage(profile.access_counts(_users(spark, d)), 60).select("hot_size", F.round("covered", 6).alias("covered"))


@query(
    f"WITH {_PROFILE}, n AS (SELECT CAST(unnest(generate_series(0, (SELECT max(user_id) + 4 FROM events))) AS BIGINT) AS id), m AS (SELECT n.id, coalesce((cum - cnt) * 100 < total * 60, false) AS is_hot FROM n LEFT JOIN c USING (id)) "
    "SELECT id, is_hot, row_number() OVER (PARTITION BY is_hot ORDER BY id) - 1 AS new_id FROM m"
)
def hotcold_remap(spark, d):
    bags = _users(spark, d)
    sizes = bags.groupBy("feature").agg((F.max("id") + 5).alias("n"))
    return profile.remap(profile.access_counts(bags), sizes, 60).select("id", "is_hot", "new_id")


@query(
    f"WITH {_PROFILE}, r AS (SELECT event_id // 100 AS batch_id, event_id AS row_id, CAST((cum - cnt) * 100 < total * 60 AS BIGINT) AS h FROM events JOIN c ON user_id = id) "
    "SELECT batch_id, row_id, h = 1 AS is_hot, CAST(sum(h) OVER w - h AS BIGINT) AS hot_offset, CAST(sum(1 - h) OVER w - (1 - h) AS BIGINT) AS cold_offset FROM r WINDOW w AS (PARTITION BY batch_id ORDER BY row_id)"
)
def hotcold_batches(spark, d):
    bags = _users(spark, d)
    hot = profile.hot_ids(profile.access_counts(bags), 60).select("id", F.lit(True).alias("is_hot"))
    rows = splits.batches(table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("id")), 100)
    marked = rows.join(hot, "id", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False))).drop("id")
    return profile.bag_offsets(marked).select("batch_id", "row_id", "is_hot", "hot_offset", "cold_offset")


_CARDS = "VALUES (0, 'c_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer)), (1, 'event_type', (SELECT count(DISTINCT event_type) FROM events)), (2, 'user_id', (SELECT count(DISTINCT user_id) FROM events)), (3, 'l_partkey', (SELECT count(DISTINCT l_partkey) FROM lineitem)), (4, 'l_suppkey', (SELECT count(DISTINCT l_suppkey) FROM lineitem)), (5, 'o_custkey', (SELECT count(DISTINCT o_custkey) FROM orders))"


@query(f"SELECT * FROM ({_CARDS}) AS t(feature, name, n)")
def cardinality(spark, d):
    parts = [("customer", "c_nationkey"), ("events", "event_type"), ("events", "user_id"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("orders", "o_custkey")]
    out = None
    for k, (t, c) in enumerate(parts):
        one = table(spark, d, t).agg(F.count_distinct(c).alias("n")).select(F.lit(k).alias("feature"), F.lit(c).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"WITH c AS (SELECT * FROM ({_CARDS}) AS t(feature, name, n)) SELECT feature, n, CASE WHEN feature = 2 THEN 'hotcold' WHEN n <= 10 THEN 'tiny' WHEN n <= 500 THEN 'merge' WHEN n BETWEEN 501 AND 100000 THEN 'split' ELSE 'medium' END AS kind FROM c"
)
def layout_plan(spark, d):
    config = layout.LayoutConfig(merge_below=500, tiny_below=10, split_from=501, split_to=100_000, num_splits=4, hot_cold=frozenset({2}))
    plan = layout.plan_table(spark, cardinality(spark, d).select("feature", "n"), config)
    return plan.groupBy("feature", "kind").agg(F.sum("size").alias("n")).select("feature", "n", "kind")


@query(
    f"WITH c AS (SELECT * FROM ({_CARDS}) AS t(feature, name, n)), s AS (SELECT min(n) AS least FROM c) SELECT feature, CAST(CASE WHEN n = least THEN 16 ELSE greatest(1, round_even(16 * power(least, 0.3) * power(n, -0.3), 0)) END AS INTEGER) AS dim FROM c, s"
)
def md_dims(spark, d):
    rows = [(r["feature"], r["n"]) for r in cardinality(spark, d).orderBy("feature").collect()]
    dims = layout.popularity_dims([n for _, n in rows], 0.3, 16)
    return spark.createDataFrame([(f, k) for (f, _), k in zip(rows, dims, strict=True)], "feature int, dim int")


@query("WITH s AS (SELECT c_nationkey AS g, c_custkey AS k, 1 + c_custkey % 13 AS n FROM customer) SELECT g, k, n, CAST(sum(n) OVER (PARTITION BY g ORDER BY k) - n AS BIGINT) AS base FROM s")
def merged_offsets(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 13).alias("n"))
    return s.withColumn("base", fx.lengths_to_offsets(F.col("n"), Window.partitionBy("g").orderBy("k")))


# Dictionaries and ETL


def _types(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.posexplode(F.array(F.xxhash64("event_type") * 0 + F.length("event_type"), "user_id")).alias("feature", "raw"))
    return e


_TYPES = "t AS (SELECT event_id, 0 AS feature, CAST(length(event_type) AS BIGINT) AS raw FROM events UNION ALL SELECT event_id, 1, user_id FROM events)"


@query(f"WITH {_TYPES}, f AS (SELECT feature, raw, min(event_id) AS m FROM t GROUP BY ALL) SELECT feature, raw, row_number() OVER (PARTITION BY feature ORDER BY m) - 1 AS code FROM f")
def dict_build_first_seen(spark, d):
    return dictionary.first_seen(_types(spark, d), "event_id")


@query(f"WITH {_TYPES}, f AS (SELECT feature, raw, min(event_id) AS m FROM t GROUP BY ALL), c AS (SELECT feature, raw, row_number() OVER (PARTITION BY feature ORDER BY m) - 1 AS code FROM f) SELECT event_id, feature, code FROM t JOIN c USING (feature, raw)")
def dict_encode(spark, d):
    rows = _types(spark, d)
    return dictionary.encode(rows, dictionary.first_seen(rows, "event_id")).select("event_id", "feature", "code")


@query(f"WITH {_TYPES} SELECT DISTINCT feature, raw, dense_rank() OVER (PARTITION BY feature ORDER BY raw) - 1 AS code FROM t")
def dict_sorted(spark, d):
    return dictionary.sorted_codes(_types(spark, d))


@query(f"WITH {_TYPES}, f AS (SELECT feature, raw, min(event_id) AS m FROM t GROUP BY ALL) SELECT feature, raw, row_number() OVER (PARTITION BY feature ORDER BY m) - 1 AS code FROM f")
def dict_incremental(spark, d):
    """A dictionary of the first events, extended by the others."""
    rows = _types(spark, d)
    early = dictionary.first_seen(rows.filter("event_id < 300"), "event_id")
    return dictionary.extend(early, rows.filter("event_id >= 300"), "event_id")


@query(f"WITH {_TYPES}, f AS (SELECT feature, raw, min(event_id) AS m FROM t GROUP BY ALL) SELECT feature, raw, row_number() OVER (PARTITION BY feature ORDER BY m) - 1 AS code FROM f")
def dict_merge_parts(spark, d):
    """Partial dictionaries of blocks of events, merged in order."""
    rows = _types(spark, d).withColumn("part", F.floor(F.col("event_id") / 250))
    own = rows.groupBy("part", "feature", "raw").agg(F.min("event_id").alias("m"))
    parts = own.select("part", "feature", "raw", (F.row_number().over(Window.partitionBy("part", "feature").orderBy("m")) - 1).alias("code"))
    return dictionary.merge_first_seen(parts)


def _raw_clicks(spark, d) -> DataFrame:
    """Raw log fields made of orders; some are empty."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    fields = [key, F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("label")]
    fields += [F.when((key + k) % 5 == 0, F.lit("")).otherwise(((key * (k + 1)) % 50 - 3).cast("string")).alias(f"i{k}") for k in range(1, 14)]
    fields += [F.when((key + k) % 7 == 0, F.lit("")).otherwise(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{k}")).cast("binary")), 1, 8)).alias(f"c{k}") for k in range(1, 27)]
    return o.select(*fields)


@query(
    "WITH k AS (SELECT unnest(generate_series(1, 13)) AS k), o AS (SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), "
    "i AS (SELECT key, sum(round(ln(greatest(CASE WHEN (key + k) % 5 = 0 THEN 0 ELSE (key * (k + 1)) % 50 - 3 END, 0) + 1), 6)) AS dense FROM o, k GROUP BY key), "
    "c AS (SELECT key, sum(CASE WHEN (key + k) % 7 = 0 THEN 0 ELSE CAST('0x' || substr(md5(CAST(key AS VARCHAR) || '-' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) % 1000 END) AS sparse FROM o, (SELECT unnest(generate_series(1, 26)) AS k) GROUP BY key) "
    "SELECT key, CAST(y AS DOUBLE) AS y, round(dense, 4) AS dense, CAST(sparse AS BIGINT) AS sparse FROM o JOIN i USING (key) JOIN c USING (key)"
)
def click_parse(spark, d):
    rows = clicks.model_ready(clicks.parse(_raw_clicks(spark, d), clicks.EtlConfig(max_ind_range=1000)))
    return rows.select(F.col("o_orderkey").alias("key"), F.col("y").cast("double").alias("y"), F.round(F.aggregate("dense", F.lit(0.0), lambda s, x: s + F.round(x, 6)), 4).alias("dense"), F.aggregate("sparse", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("sparse"))


@query("WITH k AS (SELECT unnest(generate_series(1, 26)) AS k) SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(sum(CASE WHEN (o_orderkey + k) % 7 = 0 THEN 0 ELSE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '-' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) END) AS BIGINT) AS sparse FROM orders, k GROUP BY ALL")
def binary_records(spark, d):
    """Packed to fixed-width records and unpacked again."""
    parsed = clicks.parse(_raw_clicks(spark, d)).withColumnRenamed("o_orderkey", "row_id")
    return clicks.from_records(clicks.to_records(parsed)).select("row_id", "y", F.aggregate("sparse", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("sparse"))


@query("SELECT event_id, CAST(ntile(7) OVER (ORDER BY event_id) - 1 AS INTEGER) AS day FROM events")
def day_chunks(spark, d):
    rows = splits.with_total(splits.number_rows(table(spark, d, "events").select("event_id"), "event_id"))
    return rows.select("event_id", splits.chunk_of(F.col("row_id"), F.col("n"), 7).alias("day"))


_DAYS = "t AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n, max(CAST(ts AS DATE)) OVER () AS last FROM events)"


def _by_day(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    rows = splits.with_total(rows.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("event_id")) - 1), "day")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("last"))))


@query(f"WITH {_DAYS} SELECT event_id, CASE WHEN day < last THEN 'train' WHEN k < ceil(n / 2) THEN 'test' ELSE 'val' END AS split FROM t")
def split_train_test_val(spark, d):
    return _by_day(spark, d).select("event_id", splits.last_day_halves(F.col("day"), F.col("last"), F.col("k"), F.col("n")).alias("split"))


@query(f"WITH {_DAYS} SELECT event_id, CASE WHEN day < last THEN 'train' WHEN k < ceil(n / 2) THEN 'val' ELSE 'test' END AS split FROM t")
def split_multi_hot_reader(spark, d):
    return _by_day(spark, d).select("event_id", splits.last_day_halves(F.col("day"), F.col("last"), F.col("k"), F.col("n"), "val", "test").alias("split"))


@query(f"WITH {_DAYS} SELECT event_id FROM t WHERE day = last AND k >= n - ceil(n / 2)")
def split_streaming_val(spark, d):
    return _by_day(spark, d).filter((F.col("day") == F.col("last")) & splits.streaming_validation(F.col("k"), F.col("n"))).select("event_id")


@query("WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN k < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM t")
def split_ratio(spark, d):
    rows = splits.with_total(splits.number_rows(table(spark, d, "events").select("event_id"), "event_id"))
    return rows.select("event_id", splits.ratio_split(F.col("row_id"), F.col("n")).alias("split"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type <> 'purchase') AS negative FROM events GROUP BY 1")
def label_counts_by_day(spark, d):
    rows = table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return profile.by_label_and_day(rows)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(ts AS DATE)) - count(*) AS BIGINT) AS before FROM events GROUP BY 1")
def day_sizes(spark, d):
    sizes = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("before", fx.lengths_to_offsets(F.col("n"), Window.orderBy("day")))


@query("SELECT event_id FROM events WHERE NOT (event_type <> 'purchase' AND CAST('0x' || substr(md5('s' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.4)")
def negative_subsample(spark, d):
    label = (F.col("event_type") == "purchase").cast("int")
    return table(spark, d, "events").filter(fx.keep_after_subsampling(label, F.col("event_id"), 0.4, "s")).select("event_id")


@query("WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey AS row_id, n AS length, CAST(sum(n) OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey) - n AS BIGINT) AS offset_ FROM l")
def lengths_to_offsets(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))
    w = Window.partitionBy(F.pmod("l_orderkey", F.lit(16))).orderBy("l_orderkey")
    return rows.select(F.col("l_orderkey").alias("row_id"), "length", fx.lengths_to_offsets(F.col("length"), w).alias("offset_"))


@query("SELECT l_orderkey AS row_id, count(*) AS length FROM lineitem GROUP BY 1")
def offsets_to_lengths(spark, d):
    rows = lengths_to_offsets(spark, d).withColumn("part", F.pmod("row_id", F.lit(16)))
    rows = rows.join(rows.groupBy("part").agg(F.sum("length").alias("total")), "part").drop("length")
    return rows.select("row_id", fx.offsets_to_lengths(F.col("offset_"), F.col("total"), Window.partitionBy("part").orderBy("row_id")).alias("length"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k < n // 3")
def prefix_subset(spark, d):
    return splits.prefix_subset(splits.number_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), 3).select("o_orderkey")


_BATCH = "t AS (SELECT event_id // 128 AS batch_id, count(*) AS samples, avg(value) AS loss FROM events GROUP BY 1)"


def _batches(spark, d) -> DataFrame:
    rows = splits.batches(table(spark, d, "events").select(F.col("event_id").alias("row_id"), "value"), 128)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("loss"))


@query(f"WITH {_BATCH} SELECT batch_id // 5 AS print_id, round(sum(loss * samples) / sum(samples), 4) AS loss, CAST(sum(samples) AS BIGINT) AS samples FROM t GROUP BY 1")
def batch_stats(spark, d):
    return metrics.running_loss(_batches(spark, d), 5).select("print_id", F.round("loss", 4).alias("loss"), "samples")


@query("SELECT event_id // 128 AS batch_id, count(*) AS n FROM events WHERE event_id // 128 < (SELECT count(*) FROM events) // 128 GROUP BY 1")
def drop_last(spark, d):
    rows = splits.batches(table(spark, d, "events").select(F.col("event_id").alias("row_id")), 128, drop_last=True)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BATCH} SELECT batch_id, batch_id % 3 AS rank, batch_id < (SELECT count(*) FROM t) // 3 * 3 AS kept FROM t")
def rank_assignment(spark, d):
    rows = splits.with_total(_batches(spark, d), name="_n")
    return rows.select("batch_id", splits.rank_of(F.col("batch_id"), 3).alias("rank"), splits.equalised(F.col("batch_id"), F.col("_n"), 3).alias("kept"))


@query(
    "WITH t AS (SELECT event_id, CAST(ts AS DATE) AS day, md5('x' || CAST(event_id AS VARCHAR)) AS tag, max(CAST(ts AS DATE)) OVER () AS last FROM events), o AS (SELECT event_id, row_number() OVER (ORDER BY day = last, tag) - 1 AS pos FROM t), s AS (SELECT day, count(*) AS n FROM t GROUP BY day), p AS (SELECT day, sum(n) OVER (ORDER BY day) - n AS a, sum(n) OVER (ORDER BY day) AS b FROM s) "
    "SELECT event_id, day, CAST(pos - a AS BIGINT) AS position FROM o JOIN p ON pos >= a AND pos < b"
)
def bucket_shuffle(spark, d):
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return splits.shuffled(rows, "event_id", "x").select("event_id", "day", "position")


# Interaction and scoring

_FOUR = "n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT event_id, user_id % n AS k0, event_id % n AS k1, (event_id * 7) % n AS k2, length(event_type) AS k3 FROM events, n), x AS (SELECT event_id, CAST(a.embedding AS DOUBLE[]) AS v0, CAST(b.embedding AS DOUBLE[]) AS v1, CAST(c.embedding AS DOUBLE[]) AS v2, CAST(d.embedding AS DOUBLE[]) AS v3 FROM k JOIN embeddings a ON a.vec_id = k0 JOIN embeddings b ON b.vec_id = k1 JOIN embeddings c ON c.vec_id = k2 JOIN embeddings d ON d.vec_id = k3)"


def _four(spark, d) -> DataFrame:
    n, e = _n_vectors(spark, d), _vectors(spark, d)
    rows = table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(n)).alias("k0"), F.pmod("event_id", F.lit(n)).alias("k1"), F.pmod(F.col("event_id") * 7, F.lit(n)).alias("k2"), F.length("event_type").cast("bigint").alias("k3"))
    for k in range(4):
        rows = rows.join(e.select(F.col("id").alias(f"k{k}"), F.col("vec").alias(f"v{k}")), f"k{k}")
    return rows


def _pairs_sql(with_self: bool) -> str:
    dots = [f"round(list_dot_product(v{i}, v{j}), 4) + 0.0" for i in range(4) for j in range(i + with_self)]
    return f"WITH {_FOUR} SELECT event_id, [{', '.join(dots)}] AS dots, round(v0[1], 4) + 0.0 AS first FROM x"


def _interaction(spark, d, with_self):
    z = interact.dot_interaction([F.col(f"v{k}") for k in range(4)], with_self)
    n = interact.interaction_width(4, DIM, with_self=with_self)
    rows = _four(spark, d).select("event_id", z.alias("z"))
    return rows.select("event_id", F.transform(F.slice("z", DIM + 1, n - DIM), lambda x: fx.rounded(x)).alias("dots"), fx.rounded(F.get("z", F.lit(0))).alias("first"))


@query(_pairs_sql(False))
def interaction_dot(spark, d):
    return _interaction(spark, d, False)


@query(_pairs_sql(True))
def interaction_self(spark, d):
    return _interaction(spark, d, True)


@query(f"WITH {_FOUR} SELECT event_id, CAST(256 AS INTEGER) AS width, round(list_sum(v0) + 2 * list_sum(v3), 4) + 0.0 AS digest FROM x")
def interaction_cat(spark, d):
    z = interact.cat_interaction([F.col(f"v{k}") for k in range(4)])
    rows = _four(spark, d).select("event_id", z.alias("z"))
    return rows.select("event_id", F.size("z").alias("width"), fx.rounded(fx.total(F.slice("z", 1, DIM)) + 2 * fx.total(F.slice("z", 3 * DIM + 1, DIM))).alias("digest"))


def _model() -> list:
    """Layers 4 -> 3 -> 1 with weights that follow from their places."""
    return [([[((7 * i + 3 * j) % 5 - 2) / 4 for j in range(4)] for i in range(3)], [0.1, -0.2, 0.3]), ([[0.5, -0.75, 0.25]], [0.05])]


def _model_sql(x: str) -> str:
    layers = _model()
    hidden = [f"greatest(0, {' + '.join(f'({w}) * {x}{j}' for j, w in enumerate(row))} + ({b}))" for row, b in zip(*layers[0], strict=True)]
    z = " + ".join(f"({w}) * {h}" for w, h in zip(layers[1][0][0], hidden, strict=True))
    return f"1 / (1 + exp(-({z} + ({layers[1][1][0]}))))"


_DENSE_SQL = "s AS (SELECT event_id, ln(1 + value) AS x0, (user_id % 10) / 10.0 AS x1, length(event_type) / 10.0 AS x2, (event_id % 7) / 7.0 AS x3, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)"


def _dense(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    x = F.array(fx.dense_log(F.col("value")), F.pmod("user_id", F.lit(10)) / 10.0, F.length("event_type") / 10.0, F.pmod("event_id", F.lit(7)) / 7.0)
    return e.select("event_id", x.alias("x"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(f"WITH {_DENSE_SQL} SELECT event_id, round({_model_sql('x')}, 6) AS p FROM s")
def mlp_score(spark, d):
    return _dense(spark, d).select("event_id", F.round(F.get(interact.mlp(F.col("x"), _model(), 1), F.lit(0)), 6).alias("p"))


@query(f"WITH {_DENSE_SQL} SELECT event_id, round({_model_sql('x')}, 6) AS p FROM s")
def mlp_score_wide(spark, d):
    return interact.mlp_wide(_dense(spark, d), "x", _model(), 1).select("event_id", F.round(F.get("score", F.lit(0)), 6).alias("p"))


@query(f"WITH {_DENSE_SQL} SELECT event_id, greatest(0.45, least(round({_model_sql('x')}, 6), 0.55)) AS p FROM s")
def score_clamp(spark, d):
    return mlp_score(spark, d).select("event_id", fx.clamp_score(F.col("p"), 0.45).alias("p"))


@query(f"WITH {_DENSE_SQL}, m AS (SELECT event_id, x1, x2, (0.5 * x1 + 0.25 * x2) AS l FROM s) SELECT event_id, round(x1 * (2 * l + 0.1) + x1, 4) + 0.0 AS z0, round(x2 * (-1 * l + 0.2) + x2, 4) + 0.0 AS z1 FROM m")
def interaction_cross(spark, d):
    rows = _dense(spark, d).select("event_id", F.slice("x", 2, 2).alias("x"))
    z = interact.low_rank_cross(F.col("x"), F.col("x"), [([[0.5, 0.25]], [[2.0], [-1.0]], [0.1, 0.2])])
    return rows.select("event_id", fx.rounded(F.get(z, F.lit(0))).alias("z0"), fx.rounded(F.get(z, F.lit(1))).alias("z1"))


# Metrics

_SCORES = "r AS (SELECT value AS v, CAST(event_type = 'purchase' AS INTEGER) AS y, (event_id * 37 % 101) / 100.0 AS p FROM events)"


def _scores(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0).alias("p"))


@query(
    f"WITH {_SCORES}, c AS (SELECT count(*) AS n, count(*) FILTER (round_even(p, 0) = 1 AND y = 1) AS tp, count(*) FILTER (round_even(p, 0) = 1 AND y = 0) AS fp, count(*) FILTER (round_even(p, 0) = 0 AND y = 1) AS fn, count(*) FILTER (round_even(p, 0) = y) AS ok FROM r) "
    "SELECT n, round(ok / n, 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"
)
def metrics_classification(spark, d):
    out = metrics.classification(_scores(spark, d))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision", "f1")])


@query(f"WITH {_SCORES}, a AS (SELECT sum(CASE WHEN p1.p > p2.p THEN p1.n * p2.n ELSE p1.n * p2.n / 2.0 END) AS u FROM (SELECT p, count(*) AS n FROM r WHERE y = 1 GROUP BY p) p1 JOIN (SELECT p, count(*) AS n FROM r WHERE y = 0 GROUP BY p) p2 ON p1.p >= p2.p) SELECT round(u / ((SELECT count(*) FROM r WHERE y = 1) * (SELECT count(*) FROM r WHERE y = 0)), 6) AS auc FROM a")
def roc_auc(spark, d):
    return metrics.roc_auc(_scores(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_SCORES}, t AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM c")
def avg_precision(spark, d):
    return metrics.average_precision(_scores(spark, d)).select(F.round("ap", 6).alias("ap"))


@query(
    f"WITH {_SCORES}, l AS (SELECT (p - y) * (p - y) AS se, CASE WHEN y = 1 THEN -(CASE WHEN p > 0 THEN greatest(ln(nullif(p, 0)), -100) ELSE -100 END) ELSE -(CASE WHEN p < 1 THEN greatest(ln(nullif(1 - p, 0)), -100) ELSE -100 END) END AS b, y FROM r) "
    "SELECT round(avg(se), 6) AS mse, round(avg(b), 4) AS bce, round(avg(b * CASE WHEN y = 1 THEN 2.0 ELSE 0.5 END), 4) AS wbce FROM l"
)
def losses(spark, d):
    out = metrics.losses(_scores(spark, d), (0.5, 2.0))
    return out.select(F.round("mse", 6).alias("mse"), F.round("bce", 4).alias("bce"), F.round("wbce", 4).alias("wbce"))


@query(f"WITH {_SCORES}, q AS (SELECT greatest(1e-15, least(p, 1 - 1e-15)) AS p, y FROM r) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) AS log_loss FROM q")
def log_loss(spark, d):
    return metrics.log_loss(_scores(spark, d)).select(F.round("log_loss", 4).alias("log_loss"))


@query(f"WITH {_SCORES}, c AS (SELECT least(greatest(floor(p + 0.5), 0), 1) AS c, y FROM r) SELECT CAST(sum(CAST(c <> y AS INTEGER)) AS BIGINT) AS wrong, count(*) AS n FROM c")
def misclassified(spark, d):
    return _scores(spark, d).agg(F.sum(fx.misclassified(fx.score_class_half_up(F.col("p")), F.col("y"))).alias("wrong"), F.count(F.lit(1)).alias("n"))


# Quantization

_VALUES = f"{_CELLS}"


@query(
    f"WITH {_VALUES}, s AS (SELECT (max(x) - min(x)) / 255 AS scale, min(x) AS lo FROM e), z AS (SELECT scale, -round_even(lo / scale, 0) AS zp FROM s) SELECT id, CAST(sum(least(greatest(round_even(x / scale + zp, 0), 0), 255)) AS BIGINT) AS codes, round(max(scale), 9) AS scale FROM e, z GROUP BY id"
)
def quantize_global(spark, d):
    q = quantize.quantize_global(_vectors(spark, d))
    return q.select("id", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("codes"), F.round("scale", 9).alias("scale"))


@query(
    f"WITH {_VALUES}, s AS (SELECT id, (max(x) - min(x)) / 255 AS scale, min(x) AS lo FROM e GROUP BY id), z AS (SELECT id, scale, -round_even(lo / scale, 0) AS zp FROM s) SELECT id, CAST(sum(least(greatest(round_even(x / scale + zp, 0), 0), 255)) AS BIGINT) AS codes, round(max(scale), 9) AS scale FROM e JOIN z USING (id) GROUP BY id"
)
def quantize_per_row(spark, d):
    q = quantize.quantize_rows(_vectors(spark, d))
    return q.select("id", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("codes"), F.round("scale", 9).alias("scale"))


@query(
    f"WITH {_VALUES}, s AS (SELECT id, (max(x) - min(x)) / 255 AS scale, min(x) AS lo FROM e GROUP BY id), z AS (SELECT id, scale, -round_even(lo / scale, 0) AS zp FROM s), y AS (SELECT x, (least(greatest(round_even(x / scale + zp, 0), 0), 255) - zp) * scale AS r FROM e JOIN z USING (id)) "
    "SELECT round(avg((x - r) * (x - r)), 8) AS mse, round(avg(abs(x - r)), 6) AS mae, round(max(abs(x - r)), 6) AS max_error, round(sqrt(sum((x - r) * (x - r)) / sum(x * x)), 6) AS relative FROM y"
)
def dequant_error(spark, d):
    v = _vectors(spark, d)
    e = quantize.errors(v, quantize.dequantize(quantize.quantize_rows(v)))
    return e.select(F.round("mse", 8).alias("mse"), *[F.round(c, 6).alias(c) for c in ("mae", "max_error", "relative")])


@query(f"WITH {_VALUES} SELECT round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std FROM e")
def table_stats(spark, d):
    return quantize.table_stats(_vectors(spark, d)).select(*[fx.rounded(F.col(c), 6).alias(c) for c in ("lo", "hi", "mean", "std")])


@query(f"WITH {_VALUES} SELECT (id % 8) * 64 + i - 1 AS x, id // 8 AS y, round(x, 6) + 0.0 AS v FROM e")
def tile_grid(spark, d):
    cells = _vectors(spark, d).select("id", F.posexplode("vec").alias("pos", "v"))
    x, y = quantize.tile(F.col("id"), F.col("pos"), DIM, 8)
    return cells.select(x.alias("x"), y.alias("y"), fx.rounded(F.col("v"), 6).alias("v"))


@query(f"WITH {_VALUES} SELECT id, i - 1 AS pos, round(x, 6) + 0.0 AS v FROM e")
def untile_roundtrip(spark, d):
    ident, pos = quantize.untile(F.col("x"), F.col("y"), DIM, 8)
    return tile_grid(spark, d).select(ident.alias("id"), pos.alias("pos"), "v")


@query("WITH t AS (SELECT 1 + n_nationkey AS raw, 1 + n_nationkey % 4 AS kept, 0.5 AS s FROM nation) SELECT round(avg(raw / kept), 6) AS ratio_avg, round(min(raw / kept), 6) AS ratio_min, round(max(raw / kept), 6) AS ratio_max, round(sum(raw) / 1048576 / sum(s), 9) AS mb_per_second FROM t")
def compression_totals(spark, d):
    t = table(spark, d, "nation").select((1 + F.col("n_nationkey")).alias("raw_bytes"), (1 + F.col("n_nationkey") % 4).alias("stored_bytes"), F.lit(0.5).alias("seconds"))
    out = quantize.compression_totals(t)
    return out.select(*[F.round(c, 6).alias(c) for c in ("ratio_avg", "ratio_min", "ratio_max")], F.round("mb_per_second", 9).alias("mb_per_second"))


# Drift, frequencies, traces


@query(
    "WITH v AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1), c AS (SELECT k * (SELECT count(*) FROM events) // 4 AS cut FROM (VALUES (1), (2), (3)) t(k)) "
    "SELECT cut, count(*) FILTER (lo < cut) AS before, count(*) FILTER (hi >= cut) AS after, count(*) FILTER (lo < cut AND hi >= cut) AS both, count(*) FILTER (lo < cut AND hi < cut) AS removed FROM v, c GROUP BY cut"
)
def category_drift(spark, d):
    e = table(spark, d, "events")
    n = e.count()
    cuts = spark.createDataFrame([(k * n // 4,) for k in (1, 2, 3)], "cut bigint")
    return profile.drift(e.select("user_id", F.col("event_id").alias("row_id")), cuts, "user_id")


@query("SELECT n.id, count(user_id) AS freq FROM (SELECT CAST(unnest(generate_series(0, 199)) AS BIGINT) AS id) n LEFT JOIN events ON user_id = n.id GROUP BY n.id")
def category_counts_dense(spark, d):
    return profile.frequencies(table(spark, d, "events").select(F.col("user_id").alias("id")).filter("id < 200"), 200)


@query("SELECT n.id, count(user_id) AS freq FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(user_id) FROM events))) AS BIGINT) AS id) n LEFT JOIN events ON user_id = n.id GROUP BY n.id")
def category_counts_all(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("id"))
    top = ids.agg(F.max("id")).first()[0]
    return profile.frequencies(ids, 0 if top is None else top + 1)


@query(f"WITH {_CELLS}, n AS (SELECT id, log10(sqrt(sum(x * x)) * (1 + id % 10)) AS l FROM e GROUP BY id) SELECT CAST(CASE WHEN l < -0.5 THEN 0 WHEN l >= 1.5 THEN 51 ELSE floor((l + 0.5) / 2.0 * 50) + 1 END AS BIGINT) AS bin, count(*) AS n FROM n GROUP BY 1")
def norm_histogram(spark, d):
    v = _vectors(spark, d).select("id", F.transform("vec", lambda x: x * (1 + F.col("id") % 10)).alias("vec"))
    return profile.norm_histogram(v, 50, -0.5, 1.5)


_TRACE = "t AS (SELECT event_id AS pos, user_id AS ref, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"
_SD = "s AS (SELECT pos, ref, CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(DISTINCT user_id) FROM events x WHERE x.event_id >= t.before AND x.event_id < t.pos) END AS sd FROM t)"


@query(f"WITH {_TRACE}, {_SD} SELECT pos, ref, CAST(sd AS INTEGER) AS sd FROM s")
def stack_distance(spark, d):
    rows = table(spark, d, "events").select(F.lit(0).alias("stream"), F.col("event_id").alias("pos"), F.col("user_id").alias("ref"))
    return trace.stack_distance(rows).drop("stream")


@query(f"WITH {_TRACE}, {_SD}, c AS (SELECT CAST(sd AS INTEGER) AS sd, count(*) AS n FROM s GROUP BY 1) SELECT sd, n, round(sum(n) OVER (ORDER BY sd) / (SELECT sum(n) FROM c), 6) AS cum FROM c")
def stack_cdf(spark, d):
    return trace.cumulative_distribution(stack_distance(spark, d)).select("sd", "n", F.round("cum", 6).alias("cum"))


# Optimizers


@query("SELECT step, round(CASE WHEN step < 100 THEN 1 - (100 - step) / 100.0 WHEN step < 300 THEN 0.99 WHEN step < 500 THEN greatest(1e-7, ((500 - step) / 200.0) * ((500 - step) / 200.0)) ELSE 0.000025 END, 8) AS rate FROM (SELECT CAST(unnest(generate_series(1, 599)) AS BIGINT) AS step)")
def lr_schedule(spark, d):
    return spark.range(1, 600).select(F.col("id").alias("step"), F.round(fx.warm_up_then_decay(F.col("id"), 1.0, 100, 300, 200), 8).alias("rate"))


def _gradients(spark, d) -> DataFrame:
    """A gradient for each event: a tenth of the vector that follows the user's."""
    n = _n_vectors(spark, d)
    e = table(spark, d, "events").filter("event_type = 'purchase'").select(F.pmod("user_id", F.lit(n)).alias("id"), F.pmod(F.col("event_id") + 1, F.lit(n)).alias("other"))
    return e.join(_vectors(spark, d).withColumnRenamed("id", "other"), "other").select("id", F.transform("vec", lambda x: x / 10).alias("grad"))


_GRADS = f"{_CELLS}, n AS (SELECT count(*) AS n FROM embeddings), g0 AS (SELECT user_id % n AS id, (event_id + 1) % n AS other FROM events, n WHERE event_type = 'purchase'), g AS (SELECT g0.id, e.i, sum(e.x / 10) AS g FROM g0 JOIN e ON e.id = g0.other GROUP BY g0.id, e.i)"


@query(f"WITH {_GRADS}, p AS (SELECT e.id, e.i, e.x - 0.5 * coalesce(g, 0) AS x FROM e LEFT JOIN g ON g.id = e.id AND g.i = e.i) {_digest_sql('p', 'id')}")
def sgd_step(spark, d):
    return _digest(optim.sgd(_vectors(spark, d), _gradients(spark, d), 0.5, DIM), "id")


@query(
    f"WITH {_GRADS}, m AS (SELECT id, 0.01 + sum(g * g) / 64 AS m FROM g GROUP BY id), p AS (SELECT e.id, e.i, e.x - coalesce(0.5 * g / (sqrt(m) + 1e-10), 0) AS x FROM e LEFT JOIN g ON g.id = e.id AND g.i = e.i LEFT JOIN m ON m.id = e.id) {_digest_sql('p', 'id')}"
)
def rowwise_adagrad_step(spark, d):
    state = _vectors(spark, d).withColumn("momentum", F.lit(0.01))
    return _digest(optim.rowwise_adagrad(state, _gradients(spark, d), 0.5, DIM), "id")


@query(f"WITH {_GRADS}, p AS (SELECT e.id, e.i, e.x - coalesce(0.5 * g / (sqrt(0.01 + g * g) + 1e-10), 0) AS x FROM e LEFT JOIN g ON g.id = e.id AND g.i = e.i) {_digest_sql('p', 'id')}")
def adagrad_step(spark, d):
    state = _vectors(spark, d).withColumn("state", F.array_repeat(F.lit(0.01), DIM))
    return _digest(optim.adagrad(state, _gradients(spark, d), 0.5, DIM), "id")


# Logs


@query("SELECT event_type AS config, max(value) / 1024 AS peak, round(avg(value) / 1024, 8) AS mean, arg_min(event_id, (-value, event_id)) AS peak_at FROM events WHERE value > 0 GROUP BY 1")
def bandwidth_peak(spark, d):
    out = logs.bandwidth(table(spark, d, "events").withColumnRenamed("event_type", "config"), "config", "event_id", "value")
    return out.select("config", "peak", F.round("mean", 8).alias("mean"), "peak_at")


@query("WITH s AS (SELECT event_type AS config, user_id + 1 AS l, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS m FROM events) SELECT config, round(sum(m) / sum(l) * 100, 6) AS rate FROM s WHERE m IS NOT NULL GROUP BY 1")
def cache_miss_rate(spark, d):
    e = table(spark, d, "events")
    s = e.select(F.col("event_type").alias("config"), (F.col("user_id") + 1).cast("string").alias("loads"), F.when(F.col("event_id") % 5 == 0, F.lit("<not counted>")).otherwise((F.col("event_id") % 3).cast("string")).alias("misses"))
    return logs.miss_rate(s, "config").select("config", F.round("rate", 6).alias("rate"))


@query("SELECT user_id % 4 AS threads, event_type AS config, round(avg(value), 6) AS total, round(avg(CASE WHEN event_id % 3 > 0 THEN value END), 6) AS part, count(*) AS num_runs FROM events GROUP BY ALL")
def perf_rollup(spark, d):
    r = table(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("threads"), F.col("event_type").alias("config"), F.col("value").alias("total"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("part"))
    out = logs.per_config(r, ["threads", "config"], ["total", "part"])
    return out.select("threads", "config", F.round("total", 6).alias("total"), F.round("part", 6).alias("part"), "num_runs")


_VARIANT = "CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'runtime' ELSE 'preprocessed' END"


@query(f"WITH r AS (SELECT user_id % 5 AS config, {_VARIANT} AS v, value FROM events), w AS (SELECT config, avg(value) FILTER (v = 'baseline') AS b, avg(value) FILTER (v = 'runtime') AS r, avg(value) FILTER (v = 'preprocessed') AS p FROM r GROUP BY 1) SELECT config, round(b, 6) AS baseline, round(r, 6) AS runtime, round(p, 6) AS preprocessed, floor(b / p * 100 + 1e-9) / 100 AS speedup FROM w")
def speedup_pivot(spark, d):
    r = table(spark, d, "events").select(F.pmod("user_id", F.lit(5)).alias("config"), F.expr(_VARIANT).alias("variant"), "value")
    out = logs.speedups(r, "config", "variant", "value")
    return out.select("config", *[F.round(c, 6).alias(c) for c in ("baseline", "runtime", "preprocessed")], "speedup")


@query("WITH t AS (SELECT event_type AS config, count(*) AS x FROM events GROUP BY 1) SELECT config, x, round(x / min(x) OVER (), 6) AS to_least, round(x / sum(x) OVER () * 100, 6) AS percent FROM t")
def ratio_shares(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.count(F.lit(1)).alias("x"))
    return logs.shares(t, "x").select("config", "x", F.round("to_least", 6).alias("to_least"), F.round("percent", 6).alias("percent"))


@query("WITH t AS (SELECT event_type AS config, sum(value) AS a, sum(value * (event_id % 2)) AS b FROM events GROUP BY 1) SELECT config, round((b + b / 2) / (a + a / 2), 6) AS share FROM t")
def embedding_share(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.sum("value").alias("a"), F.sum(F.col("value") * (F.col("event_id") % 2)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("config", F.round(logs.embedding_share(b, b / 2, a, a / 2), 6).alias("share"))


@query("WITH t AS (SELECT event_type AS config, (event_id % 9) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS b FROM events) SELECT config, CAST(sum(b) AS DOUBLE) AS bytes FROM t GROUP BY 1")
def memory_rollup(spark, d):
    text = F.concat((F.col("event_id") % 9).cast("string"), F.expr("CASE event_id % 3 WHEN 0 THEN ' b' WHEN 1 THEN ' Kb' ELSE ' Mb' END"))
    return table(spark, d, "events").select(F.col("event_type").alias("config"), logs.to_bytes(text).alias("b")).groupBy("config").agg(F.sum("b").alias("bytes"))


# The whole model


def _forward_layers() -> tuple[list, list]:
    """Bottom layers 4 -> 4 and top layers 7 -> 3 -> 1 with weights that follow from their places."""
    bottom = [([[((3 * i + 5 * j) % 7 - 3) / 4 for j in range(4)] for i in range(4)], [0.1, 0.0, -0.1, 0.2])]
    top = [([[((2 * i + 3 * j) % 5 - 2) / 8 for j in range(7)] for i in range(3)], [0.2, 0.1, 0.0]), ([[1.5, -1.0, 0.5]], [-0.1])]
    return bottom, top


def _layer_sql(layer, x: str, relu: bool = True) -> str:
    rows = [f"list_dot_product({x}, [{', '.join(f'CAST({w} AS DOUBLE)' for w in row)}]) + ({b})" for row, b in zip(*layer, strict=True)]
    return "[" + ", ".join(f"greatest(0, {r})" if relu else r for r in rows) + "]"


def _forward_sql(last: str) -> str:
    bottom, top = _forward_layers()
    return (
        f"WITH {_DENSE_SQL}, e AS (SELECT vec_id AS id, list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), "
        f"r AS (SELECT s.event_id, s.y, {_layer_sql(bottom[0], '[x0, x1, x2, x3]')} AS b, e0.v AS f0, list_transform(list_zip(e1.v, e2.v), lambda q: q[1] + q[2]) AS f1 FROM s JOIN events USING (event_id) "
        "JOIN e e0 ON e0.id = user_id % (SELECT count(*) FROM embeddings) JOIN e e1 ON e1.id = event_id % 16 JOIN e e2 ON e2.id = event_id % 5), "
        "z AS (SELECT event_id, y, list_concat(b, [list_dot_product(f0, b), list_dot_product(f1, b), list_dot_product(f1, f0)]) AS z FROM r), "
        f"h AS (SELECT event_id, y, {_layer_sql(top[0], 'z')} AS h FROM z), p AS (SELECT event_id, y, round(greatest(0.01, least(1 / (1 + exp(-{_layer_sql(top[1], 'h', False)}[1])), 0.99)), 6) AS p FROM h) {last}"
    )


def _forward(spark, d) -> DataFrame:
    n = _n_vectors(spark, d)
    rows = _dense(spark, d).select(F.col("event_id").alias("row_id"), F.col("x").alias("dense"), "y")
    ids = F.array(*[F.struct(F.lit(f).alias("feature"), i.alias("id")) for f, i in ((0, fx.hash_cap(F.col("user_id"), n)), (1, F.pmod("event_id", F.lit(16))), (1, F.pmod("event_id", F.lit(5))))])
    bags = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.explode(ids).alias("x")).select("row_id", "x.feature", "x.id")
    tables = _vectors(spark, d).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("feature"), "id", F.slice("vec", 1, 4).alias("vec"))
    bottom, top = _forward_layers()
    return model.forward(rows, bags, tables, [0, 1], 4, bottom, top, threshold=0.01).select(F.col("row_id").alias("event_id"), "y", F.round("p", 6).alias("p"))


@query(_forward_sql("SELECT event_id, y, p FROM p"))
def model_forward(spark, d):
    return _forward(spark, d)


@query(
    _forward_sql(
        ", c AS (SELECT count(*) AS n, count(*) FILTER (round_even(p, 0) = y) AS ok, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM p), "
        "a AS (SELECT sum(CASE WHEN p1.p > p2.p THEN p1.n * p2.n ELSE p1.n * p2.n / 2.0 END) / ((SELECT sum(y) FROM p) * (SELECT sum(1 - y) FROM p)) AS auc FROM (SELECT p, count(*) AS n FROM p WHERE y = 1 GROUP BY p) p1 JOIN (SELECT p, count(*) AS n FROM p WHERE y = 0 GROUP BY p) p2 ON p1.p >= p2.p) "
        "SELECT n, round(ok / n, 6) AS accuracy, round(loss, 6) AS log_loss, round(auc, 6) AS auc FROM c, a"
    )
)
def model_metrics(spark, d):
    scored = _forward(spark, d)
    one = metrics.classification(scored).select("n", F.round("accuracy", 6).alias("accuracy"))
    loss = metrics.log_loss(scored).select(F.round("log_loss", 6).alias("log_loss"))
    return one.crossJoin(loss).crossJoin(metrics.roc_auc(scored).select(F.round("auc", 6).alias("auc")))  # one row each


@query("SELECT 0 AS feature, max(user_id) + 1 AS n FROM events UNION ALL SELECT 1, max(l_partkey) + 1 FROM lineitem")
def table_sizes(spark, d):
    return model.table_sizes(_users(spark, d).unionByName(table(spark, d, "lineitem").select(F.lit(1).alias("feature"), F.col("l_partkey").alias("id"))))


@query("SELECT event_id // 100 AS batch_id, count(*) AS n FROM events WHERE event_id // 100 < 7 GROUP BY 1")
def limited_batches(spark, d):
    rows = splits.batches(table(spark, d, "events").select(F.col("event_id").alias("row_id")), 100)
    return model.limited(rows, 7).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_USERS}, r AS (SELECT id, CAST(x.lo AS DOUBLE) AS lo, CASE WHEN x.hi > x.lo THEN (x.hi - x.lo) / 15 ELSE 1.0 END AS scale FROM (SELECT vec_id AS id, {{'lo': CAST(list_min(embedding) AS DOUBLE), 'hi': CAST(list_max(embedding) AS DOUBLE)}} AS x FROM embeddings)), "
    f"{_CELLS}, z AS (SELECT id, i, round_even((x - lo) / scale, 0) * scale + lo AS x FROM e JOIN r USING (id)), p AS (SELECT row_id, i, sum(x) AS x FROM b JOIN z USING (id) GROUP BY row_id, i) {_digest_sql('p')}"
)
def quantized_lookup_4bit(spark, d):
    """Codes packed two to a byte, and unpacked where they are looked up."""
    codes = quantize.quantize_low(_vectors(spark, d), 4)
    stored = codes.select("id", quantize.packed_nibbles(F.col("q")).alias("q"), "scale", "low")
    return _digest(lookup.quantized_bag(_user_bags(spark, d), stored.withColumn("q", quantize.unpacked_nibbles(F.col("q"), DIM)), DIM))


# Synthetic data and streams (no SQL counterpart: the same seeds, or Spark's own streaming engine)


@query()
def synth_uniform_bags(spark, d):
    return synth.uniform_bags(spark, 1000, [10, 100, 1000], 8)


@query()
def synth_gaussian_bags(spark, d):
    return synth.gaussian_bags(spark, 1000, [10, 100, 1000], 8, -1.0, 1.0)


@query()
def synth_trace(spark, d):
    return trace.generate(spark.range(4).withColumnRenamed("id", "stream"), list(range(20)), [(0, 0.3), (1, 0.6), (4, 1.0)], 50)


@query()
def synth_multi_hot_pareto(spark, d):
    return synth.expansion(spark, 200, 4, "pareto")


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY 1")
def stream_access_counts(spark, d):
    return streams.drain(streams.access_counts(streams.events_stream(spark, d, "events.parquet"), "user_id"), f"counts_{uuid.uuid4().hex}", "complete")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = streams.drain(streams.tumbling(streams.events_stream(spark, d, "events.parquet")), f"tumbling_{uuid.uuid4().hex}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"
)
def stream_sessions(spark, d):
    out = streams.drain(streams.sessions(streams.events_stream(spark, d, "events.parquet")), f"sessions_{uuid.uuid4().hex}", "complete")
    return out.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")], "n")
