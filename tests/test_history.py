import datetime as dt
import random

import pytest

from foliospark.operators.history import bitemporal_ledger, versions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "slug string, at string, rec timestamp_ntz, v double, w string"


def belief(deliveries, key, now):
    """What is held at ``now``: {moment: (v, w)} of the last deliveries recorded by then."""
    out = {}
    for slug, at, rec, v, w in sorted(deliveries, key=lambda r: r[2]):
        if slug == key and rec <= now:
            out[at] = (v, w)
    return out


def test_every_belief_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows, seen = [], set()
        for _ in range(120):
            day, sec = rng.randrange(6), rng.randrange(4)
            rec = T0 + dt.timedelta(minutes=rng.randrange(100_000))
            if rec in seen:
                continue
            seen.add(rec)
            rows.append((rng.choice("ab"), f"2024010{day + 1}00000{sec}", rec, float(rng.randrange(3)), rng.choice(["x", None])))
        ledger = bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "slug", "at", "rec", ["v", "w"]).collect()
        for key in "ab":
            for now in sorted(r[2] for r in rows if r[0] == key):
                held = belief(rows, key, now)
                moments = sorted(held)
                want = {(m, moments[i + 1] if i + 1 < len(moments) else None, *held[m]) for i, m in enumerate(moments)}
                got = [(r.valid_from, r.valid_to, r.v, r.w) for r in ledger if r.entity == key and r.recorded_from <= now and (r.recorded_to is None or r.recorded_to > now)]
                assert len(got) == len(set(got)) and set(got) == want


def test_versions_join_equal_neighbours(spark):
    rows = [("a", f"2024010{d}000000", T0 + dt.timedelta(days=d), v, None) for d, v in ((1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, None), (6, 1.0))]
    got = versions(bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "slug", "at", "rec", ["v"]), ["v"]).orderBy("valid_from").collect()
    assert [(r.valid_from[:8], r.valid_to and r.valid_to[:8], r.v) for r in got] == [("20240101", "20240103", 1.0), ("20240103", "20240104", 2.0), ("20240104", "20240106", None), ("20240106", None, 1.0)]


def test_late_row_splits_and_nothing_is_overwritten(spark):
    d = lambda n: T0 + dt.timedelta(days=n)
    rows = [("a", "20240101000000", d(1), 1.0, None), ("a", "20240110000000", d(10), 3.0, None), ("a", "20240105000000", d(20), 2.0, None)]
    got = {(r.valid_from[:8], r.valid_to and r.valid_to[:8], r.v, r.recorded_from, r.recorded_to) for r in bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "slug", "at", "rec", ["v"]).collect()}
    assert ("20240101", "20240110", 1.0, d(10), d(20)) in got and ("20240101", "20240105", 1.0, d(20), None) in got and ("20240105", "20240110", 2.0, d(20), None) in got
    assert ("20240101", None, 1.0, d(1), d(10)) in got


@pytest.mark.parametrize("rows, n", [([], 0), ([(None, "20240101000000", T0, 1.0, "x")], 0), ([("a", None, T0, 1.0, "x")], 0), ([("a", "20240101000000", None, None, None)], 1), ([("a", "20240101000000", T0, 1.0, "x")] * 3, 1)])
def test_nulls_repeats_and_empty_tables(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("w", "moment")  # a clashing name
    assert bitemporal_ledger(df, "slug", "at", "rec", ["v"]).count() == n


def test_very_long_attributes_and_ties(spark):
    rows = [("a", "20240101000000", T0, 1.0, "y" * 200_000), ("a", "20240101000000", T0, 2.0, "z" * 200_000)]
    got = bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "slug", "at", "rec", ["v", "w"]).collect()
    assert len([r for r in got if r.recorded_to is None]) == 1
