"""Numbering by a total order: 1..n, whole, at any number of partitions."""

import pytest
from pyspark.sql import functions as F

from strandline import shared
from strandline.operators import resolve

MANY = 5_000_000


def with_conf(spark, partitions, adaptive):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.fixture
def conf(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    yield lambda n, adaptive: with_conf(spark, n, adaptive)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("partitions", "adaptive", "n"), [(8, "true", MANY), (32, "false", MANY), (200, "true", MANY), (200, "false", 100_000), (32, "true", 100_000), (8, "false", 100_000)])
def test_ids_are_whole(spark, conf, partitions, adaptive, n):
    conf(partitions, adaptive)
    # a third of the rows share one key, others come in pairs
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.floor(F.col("id") * 2654435761 % 4294967291 / 2))
    rows = spark.range(n).select("id", key.alias("key"), F.concat(F.lit("row "), F.col("id")).alias("text"))
    got = resolve.assign_ids(rows, "key", out="nth")
    square = F.sum(F.col("nth").cast("decimal(20,0)") * F.col("nth"))
    s = got.agg(F.count("*").alias("n"), F.min("nth").alias("least"), F.max("nth").alias("most"), F.sum("nth").alias("sum"), square.alias("squares"), F.sum("id").alias("ids")).first()
    assert (s["n"], s["least"], s["most"], s["ids"]) == (n, 1, n, n * (n - 1) // 2)
    assert (s["sum"], int(s["squares"])) == (n * (n + 1) // 2, n * (n + 1) * (2 * n + 1) // 6)
    # ids follow the key: each key's ids are one stretch, in the order of keys
    spans = got.groupBy("key").agg(F.min("nth").alias("a"), F.max("nth").alias("z"), F.count("*").alias("n"))
    assert spans.filter("z - a + 1 <> n").isEmpty()
    ends = got.groupBy(F.floor(F.col("nth") / 1000).alias("block")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    pairs = ends.alias("x").join(ends.alias("y"), F.expr("y.block = x.block + 1"))
    assert pairs.filter("x.high > y.low").isEmpty()


def test_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a"), ("k", "a"), ("k", "a"), ("k", "b"), (None, "a")], "key string, text string")
    got = sorted((r["id"], r["key"]) for r in resolve.assign_ids(rows, "key").collect())
    assert [i for i, _ in got] == [1, 2, 3, 4, 5] and [k for _, k in got] == [None, None, "k", "k", "k"]
    assert resolve.assign_ids(rows.limit(0), "key").count() == 0


def test_numbered_rows_do_not_change_when_read_again(spark):
    got = resolve.assign_ids(spark.range(20_000).withColumn("key", F.col("id") % 10), "key", out="nth")
    assert got.join(got.select("id", F.col("nth").alias("again")), "id").filter("nth <> again").isEmpty()


def test_shared_folder(spark):
    table = shared.written(spark.range(3), "three")
    assert table.count() == 3 and shared.clear(spark) >= 1 and shared.clear(spark) == 0
