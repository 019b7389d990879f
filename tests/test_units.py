import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark.functions.quantities import read_note, read_quantity
from foliospark.operators import units
from foliospark.operators.units import changepoints, matching_factor, points, segments, unit_histories

CASES = [
    (("Cash balance", "68,1 Mio. USD", "USD"), ("68100000", "USD", "USD")), (("ARR estimate", "₩95.9B", "KRW M"), ("95900000000", "USD", "KRW")), (("Debt facility (USDm)", "8930", None), ("8930000000", "USD", "USD")),
    (("Debt facility", "7.36亿元", None), ("736000000", "USD", "CNY")), (("Total raised", "8.22億円", None), ("822000000", "USD", "JPY")), (("Total raised", "US$609,000,000", "USD M"), ("609000000", "USD", "USD")),
    (("Revenue run rate", "4 110 millions USD", "USD M"), ("4110000000", "USD", "USD")), (("Total raised", "₹1,23,45,678", None), ("12345678", "USD", "INR")), (("Total raised", "90 lakh rupees", None), ("9000000", "USD", "INR")),
    (("Contract backlog", "Reported at €14.4M in 2024", "€ M"), ("14400000", "USD", "EUR")), (("Headcount", "约0.545万", "人"), ("5450", "count", None)), (("Headcount", "5.2", "M people"), ("5200000", "count", None)),
    (("Employees", "66 100 salariés", None), ("66100", "count", None)), (("Active users (thousands)", "7", None), ("7000", "count", None)), (("Market share", "79,1 %", None), ("7910", "bp", None)), (("Market share", "0.604", "ratio"), ("6040", "bp", None)),
    (("Churn", "2890 bps", None), ("2890", "bp", None)), (("Plant floor area in sq ft", "100", None), ("9.290304", "m2", None)), (("Installed capacity", "5642MW", None), ("5642000", "kW", None)), (("Annual output", "2 lb", "kg"), ("0.90718474", "kg", None)),
    (("Stores", "6+", "stores"), ("6", "count", None)), (("Storage delivered", "248.5 GWh", None), ("248500000", "kWh", None)), (("Plant floor area", "42.83m²", None), ("42.83", "m2", None)),
]
NONE = [("Last round", "2024-05-12", "date"), ("Founded", "2016", "year"), ("Founded", "2016", None), ("Disclosure grade", "5", None), ("Headcount range", "360 to 720", "employees"), ("Reported valuation range", "$37B-$39B", "USD"), ("ARR estimate", "12", None), ("x", None, None), ("x", "", "USD"), ("Total raised", "n/a", "USD M"), (None, "n/a", None), ("Customers", "y" * 200_000, "count")]


@pytest.mark.parametrize("fields, want", CASES)
def test_stated_quantities(fields, want):
    q = read_quantity(*fields)
    assert (q.number * q.factor, q.std_unit, q.currency) == (Decimal(want[0]), *want[1:])


@pytest.mark.parametrize("fields", NONE)
def test_no_quantity(fields):
    assert read_quantity(*fields) is None


def test_notes():
    assert read_note("金额单位为十亿美元。") == {"money": (Decimal(10**9), "USD")} and read_note("Montants en M€.") == {"money": (Decimal(10**6), "EUR")}
    assert read_note("Key metrics are given in full US dollars, not in millions.") == {"money": (Decimal(1), "USD")} and read_note("Percent fields hold ratios (1 = 100 %).") == {"rate": (Decimal(10000), None)}
    assert read_note("Counts (customers, headcount) given in '000.") == {"count": (Decimal(1000), None)} and read_note(None) == read_note("Headcount excludes contractors.") == {}


def test_changepoints_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        y = [rng.choice([0, 3, 6]) + rng.gauss(0, 0.1) for _ in range(rng.randrange(1, 10))]

        def cost(starts):
            ends = [*starts[1:], len(y)]
            return sum(0.4 + sum((v - sum(y[a:b]) / (b - a)) ** 2 for v in y[a:b]) for a, b in zip(starts, ends))

        every = (c for n in range(len(y)) for c in itertools.combinations(range(1, len(y)), n))
        assert abs(cost(changepoints(y, 0.4)) - min(cost([0, *c]) for c in every)) < 1e-9


def test_segments_with_anchors_are_optimal_in_any_stream():
    rng = random.Random(5)
    for every in (1, 3, 2048):
        units.SETTLE_EVERY = every
        for _ in range(60):
            n = rng.randrange(1, 9)
            y = [rng.choice([0, 0.3, 3]) + rng.gauss(0, 0.1) for _ in range(n)]
            told = [rng.choice([None, None, 1, 2]) for _ in range(n)]

            def cost(starts):
                ends = [*starts[1:], n]
                if any(len({u for u in told[a:b] if u}) > 1 for a, b in zip(starts, ends)):
                    return float("inf")
                return sum(0.05 + sum((v - sum(y[a:b]) / (b - a)) ** 2 for v in y[a:b]) for a, b in zip(starts, ends))

            best = min(cost([0, *c]) for k in range(n) for c in itertools.combinations(range(1, n), k))
            got = segments(y, told, 0.05)
            assert abs(cost([a for a, *_ in got]) - best) < 1e-9 and [b for _, b, *_ in got] == [*[a for a, *_ in got][1:], n]
            assert all(u == next((x for x in told[a:b] if x), None) for a, b, _, u in got)
    units.SETTLE_EVERY = 2048


def test_a_stream_holds_only_what_is_not_settled():
    search, rng = units.Search(0.05), random.Random(1)
    got, most = [], 0
    for i in range(30_000):
        search.push(rng.gauss(0, 0.02) + (i // 1000) % 2, None)
        if i % 100 == 0:
            got += search.settled()
            most = max(most, len(search.units))
    got += search.rest()
    assert [a for a, *_ in got] == list(range(0, 30_000, 1000)) and most < 2_500


def test_a_border_is_certain_beyond_the_stated_distance():
    rng = random.Random(2)
    for _ in range(400):
        y = [rng.choice([0, 0.7, 1.3]) + rng.gauss(0, 0.2) for _ in range(rng.randrange(2, 30))]
        starts = set(changepoints(y, 0.05))
        assert all(i in starts for i in range(1, len(y)) if abs(y[i] - y[i - 1]) > 0.4**0.5)


def test_matching_factor():
    assert matching_factor(2.5, (1000.0,), 0.08) is None and matching_factor(-2.95, (1000.0,), 0.08) == 1 / 1000


def _numbers(values, factors):
    for i, (v, f) in enumerate(zip(values, factors)):
        if v is not None:
            yield i, "v", Decimal(v), (Decimal(f) if f else None), "USD", None, None


def histories(df, carried=("i",), **kw):
    return unit_histories(points(df, list(dict.fromkeys(["s", *carried])), ["v", "f"], _numbers), ["s"], ["i"], carried, **kw)


def test_histories_reverse_unit_changes(spark):
    rows = [("a", i, "5" if i < 4 else "5000", "1000" if i < 4 else None, "x") for i in range(8)] + [("b", 1, None, None, "x"), ("a", None, "0", None, "x")]
    df = spark.createDataFrame(rows, "s string, i int, v string, f string, series string")
    got = histories(df).orderBy("i").collect()
    assert [float(r.number) * float(r.factor) for r in got if r.i is not None] == [5000.0] * 8 and [r.shift for r in got if r.shift] == [1000.0]
    assert sum(not r.stated for r in got) == 5 and len(got) == 9 and [(r.factor, r.segment) for r in got if r.i is None] == [(None, None)]
    assert histories(df.limit(0)).count() == 0


def test_only_the_named_factors_of_a_field_are_reversed(spark):
    df = spark.createDataFrame([("a", i, "5" if i < 4 else "50", "7" if i < 4 else None) for i in range(8)], "s string, i int, v string, f string")
    of = lambda **kw: {float(r.factor) for r in histories(df, **kw).filter("i > 3").collect()}
    assert of() == {0.7} and of(known={"v": (1000.0,)}) == {7.0} and of(known={"other": (1000.0,)}) == {0.7}


def test_unstated_numbers_are_filled_from_either_side(spark):
    row = lambda told: spark.range(9000).select(F.lit("a").alias("s"), F.col("id").cast("int").alias("i"), F.when(F.col("id") < 4096, "7").otherwise("7000").alias("v"), F.when(told, F.when(F.col("id") < 4096, "1000").otherwise("1")).alias("f"))
    for told in (F.col("id") < 100, F.col("id") > 8500):
        got = histories(row(told)).orderBy("i").collect()
        assert {float(r.number) * float(r.factor) for r in got} == {7000.0}
        assert [(r.i, r.shift) for r in got if r.shift] == [(4096, 1000.0)] and [r.segment for r in got] == [0] * 4096 + [1] * 4904
    assert histories(row(F.lit(False))).filter("factor is not null").count() == 0


def _brute(rows, known=units.KNOWN_FACTORS):
    """Each history in memory: (segment, shift, factor) of each row in order."""
    import math

    out = {}
    for s in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        found = segments([math.log10(float(r[2])) for r in mine], [r[3] for r in mine], 0.05)
        shifts = [None] + [matching_factor(b[2] - a[2], known, 0.08) for a, b in zip(found, found[1:])]
        steps = list(itertools.accumulate(math.log10(x) if x else 0 for x in shifts))
        base = [None if f[3] is None else math.log10(float(f[3])) + st for f, st in zip(found, steps)]
        for k, (a, b, _, u) in enumerate(found):
            near = next((x for x in base[k::-1] if x is not None), next((x for x in base if x is not None), None))
            factor = float(u) if u is not None else None if near is None else 10 ** (near - steps[k])
            for i in range(a, b):
                out[s, mine[i][1]] = (k, shifts[k] if i == a else None, factor)
    return out


def test_rows_do_not_depend_on_partitions(spark):
    rng, rows = random.Random(8), []
    for s, n in (("a", 700), ("b", 90), ("c", 1), ("d", 300)):
        scale = 1
        for i in range(n):
            scale = rng.choice([1, 10**3, 10**6]) if rng.random() < 0.05 else scale
            rows.append((s, i, repr(round(rng.uniform(4, 6) * scale, 3)), rng.choice([None, None, None, str(10**6 // scale)])))
    df, want = spark.createDataFrame(rows, "s string, i int, v string, f string"), _brute(rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 8, 64, 400):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = histories(df.repartition(min(parts, 16)), ("s", "i")).collect()
            assert len(got) == len(rows)
            for r in got:
                k, shift, factor = want[r.s, r.i]
                assert (r.segment, r.shift) == (k, shift) and (r.factor is None) == (factor is None) and (factor is None or abs(float(r.factor) / factor - 1) < 1e-9)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [[(None, None, "5", None), (None, None, "5", None), ("a", 1, None, None)], [("a", 1, "1" * 400, "2"), ("a", 2, "-3", None), ("a", 3, "0", "2")]])
def test_nulls_ties_and_numbers_without_logarithm(spark, rows):
    got = histories(spark.createDataFrame(rows, "s string, i int, v string, f string"), ("i",)).collect()
    assert len(got) == sum(r[2] is not None for r in rows)


def test_cards_with_a_note_that_is_not_read_take_their_history(spark, tmp_path):
    from foliospark.plans import quantities

    names = list(quantities.METRIC_KINDS)
    money = lambda v: (v, *[None] * 8)
    rows = [(f"2024010{i}000000-a", money(v), note, i) for i, (v, note) in enumerate([(50.0, None), (52.0, ""), (0.051, "Nur Milliardenbeträge sonst nichts"), (53.0, "Headcount excludes contractors."), (54.0, None)])]
    rows.append(("20240109000000-b", money(0.05), "Wording that no pattern knows", 9))
    spark.createDataFrame(rows, f"run_id string, key_metrics struct<{', '.join(f'{n}: double' for n in names)}>, coverage_notes string, ingested_at int").write.parquet(str(tmp_path / "report_card.parquet"))
    spark.createDataFrame([], "fact_id long, run_id string, fact_label string, fact_value string, fact_unit string, ingested_at int").write.parquet(str(tmp_path / "cover_fact.parquet"))
    spark.createDataFrame([("USD", 2024, 1.0)], "currency_code string, rate_year int, usd_per_unit double").write.parquet(str(tmp_path / "fx_rate.parquet"))
    got = {r.rec_key[:8]: r.std_value for r in quantities.p1_found(spark, str(tmp_path)).collect()}
    assert got == {"20240100": 50_000_000, "20240101": 52_000_000, "20240102": 51_000_000, "20240103": 53_000_000, "20240104": 54_000_000, "20240109": 50_000}
