"""Plans: what reaches the scan, and which joins Spark picks."""

from pyspark.sql import functions as F

from recframe import queries
from recframe.operators import lookup

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    text = plan(queries.basket_embedding_sum(spark, DATA))
    assert "l_comment" not in text and "l_quantity" not in text and "l_partkey" in text


def test_hot_side_is_broadcast_and_cold_side_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bags = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 10).alias("id"))
        table = spark.range(10).select("id", F.array(F.lit(1.0)).alias("vec"))
        text = plan(lookup.bag(bags, table, 1))
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
        assert "BroadcastHashJoin" in plan(lookup.bag(bags, F.broadcast(table), 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookups_combine_before_the_shuffle(spark):
    assert "partial_sum" in plan(queries.basket_embedding_sum(spark, DATA))


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
