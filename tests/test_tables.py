import datetime as dt
import os

from pyspark.sql import functions as F

from foliospark.operators import rollups
from foliospark.tables import cut, last_delivery, release, spread, strip

T = dt.datetime(2024, 1, 1)


def test_last_delivery(spark):
    rows = [("a", T, 1), ("a", T + dt.timedelta(1), 2), ("b", None, 3), ("b", T, 4), (None, T, 5), (None, None, 6), ("c", T, 7), ("c", T, 8), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, ingested_at timestamp_ntz, delivery_rank int")  # a clashing name
    got = {r.k: r.delivery_rank for r in last_delivery(df, ["k"]).collect()}
    assert {k: got[k] for k in ("a", "b", None, "d")} == {"a": 2, "b": 4, None: 5, "d": None} and got["c"] in (7, 8) and len(got) == 5
    assert got["c"] == {r.k: r.delivery_rank for r in last_delivery(df.orderBy(F.desc("delivery_rank")).repartition(3), ["k"]).collect()}["c"]
    assert last_delivery(df.limit(0), ["k"]).count() == 0


def test_cut_and_release(spark):
    df = cut(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and os.path.isdir(df._cut_path.removeprefix("file:"))
    release(df)
    assert not os.path.isdir(df._cut_path.removeprefix("file:"))


def test_spread_only_scans(spark, sf):
    one = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == one.count()
    grouped = one.groupBy("doc_id").count()
    assert spread(grouped) is grouped


def test_strip(spark):
    df = spark.createDataFrame([("　 a b \n",), ("",), (None,), (" ",)], "x string")
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == ["a b", "", None, ""]


def test_rollups_of_nothing_and_of_repeats(spark):
    schema = "id string, labels array<string>, tags array<string>, score double, amount double"
    none = spark.createDataFrame([], schema)
    assert rollups.by_label(none, "id", F.col("labels"), F.col("tags"), "score", "amount").count() == 0
    assert rollups.totals(none, F.col("score"), F.col("amount"), F.lit(True)).head()[:] == (0, 0.0, 0.0, 0.0, 0)
    df = spark.createDataFrame([("1", ["A", "A", "B"], ["t", "u"], 4.0, 1.0), ("1", ["A"], ["v"], 4.0, 1.0), ("2", ["A"], None, 8.0, None)], schema)
    got = {r.label: r for r in rollups.by_label(df, "id", F.col("labels"), F.col("tags"), "score", "amount", 2).collect()}
    assert (got["A"].n, got["A"].mean, got["A"].first_tags, got["A"].more_tags, got["A"].rank_label, got["A"].share, got["B"].share) == (2, 6.0, "t|u", 1, "01", 100, 50)
