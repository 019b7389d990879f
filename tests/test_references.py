import random

from pyspark.sql import functions as F

from foliospark.operators.references import clean_id, contiguous_runs, missing_references


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"{p}{n:03}" for p in ("CO", "CM", "S") for n in range(40)] + ["CO1", "CO01", "X", "9", "12345678901234567890", "", "CO70000", "CO65535", "CO65536"]
    ids = {(s, k, rng.choice(pool)) for s in "ab" for k in "xy" for _ in range(60)}
    refs = [(s, k, rng.choice(pool), o) for s in ("a", "b", "c", None) for k in "xy" for o in range(80)]
    got = missing_references(spark.createDataFrame(refs, "scope string, kind string, ref string, owner int"), spark.createDataFrame(list(ids), "scope string, kind string, id string"))
    assert set(map(tuple, got.select("scope", "kind", "ref", "owner").collect())) == {r for r in refs if r[:3] not in ids}


def test_runs_are_maximal(spark):
    ids = spark.createDataFrame([("a", "x", f"C{n:03}") for n in (1, 2, 3, 5, 6, 9)] + [("a", "x", "C001")], "scope string, kind string, id string")
    assert sorted((r["first"], r["last"]) for r in contiguous_runs(ids).collect()) == [(1, 3), (5, 6), (9, 9)]


def test_clean_ids(spark):
    rows = [(" co001 ",), ("[CO001]",), (" [co001]　",), ("",), ("  ",), (None,), ("[ ]",)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(clean_id(F.col("r"))).collect()]
    assert got == ["CO001"] * 3 + [None] * 4


def test_empty_tables_nulls_repeats_long(spark):
    none_ids = spark.createDataFrame([], "scope string, kind string, id string")
    none_refs = spark.createDataFrame([], "scope string, kind string, ref string, end int")
    refs = spark.createDataFrame([("a", "x", "C1", 1)] * 3 + [("a", "x", None, 2), ("a", "x", "y" * 100_000, 3)], "scope string, kind string, ref string, end int")
    assert missing_references(none_refs, none_ids).count() == 0
    assert missing_references(refs, none_ids).count() == 2
    assert missing_references(refs, spark.createDataFrame([("a", "x", None), ("a", "x", "C1")], "scope string, kind string, id string")).count() == 1
