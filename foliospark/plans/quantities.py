"""Problem 1: the quantities of facts and cards in common units."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.quantities import read_note, read_number
from foliospark.operators import units
from foliospark.tables import last_delivery, read

# The kind and common factor of each metric as its name states them.
METRIC_KINDS = {
    "valuation_usd_m": "money", "revenue_run_rate_usd_m": "money", "arr_usd_m": "money", "total_raised_usd_m": "money",
    "revenue_growth_yoy_pct": "rate", "gross_margin_pct": "rate", "nrr_pct": "rate", "customer_count": "count", "headcount": "count",
}
_DEFAULT = {"money": (Decimal(10**6), "USD"), "rate": (Decimal(100), None), "count": (Decimal(1), None)}
# By what a card's recorded numbers can differ from those in the units of their names.
_NOTED = {"money": (1e3, 1e6), "rate": (1e2,), "count": (1e3,)}
_STD = {"money": "USD", "rate": "bp", "count": "count"}


def fact_statements(labels, values, units_):
    for i, fields in enumerate(zip(labels, values, units_)):
        q = read_number(*fields)
        if q is not None:
            yield i, "fact_value", q.number, q.factor, q.std_unit, q.currency, None


def card_statements(notes, *columns):
    """A card without a note has the units of its metrics' names, one with a note that is read those of the note; where a note isn't understood the history decides, and the names only if it can't."""
    for i, (note, *metrics) in enumerate(zip(notes, *columns)):
        said = read_note(note)
        told = bool(said) or not (note or "").strip()
        for (name, kind), v in zip(METRIC_KINDS.items(), metrics):
            if v is not None and v == v and abs(v) != float("inf"):
                factor, cur = said.get(kind, _DEFAULT[kind])
                yield i, name, Decimal(repr(v)), factor if told else None, _STD[kind], cur, factor


_CARRIED = ["rec_table", "key", "run_id", "slug", "topic"]


def fact_points(spark: SparkSession, d: str) -> DataFrame:
    facts = last_delivery(read(spark, d, "cover_fact").select("fact_id", "run_id", "fact_label", "fact_value", "fact_unit", "ingested_at"), ["fact_id"])
    topic = F.regexp_replace("fact_label", r"\s*(?:\([^()]*\)|\sin\s.*)\z", "")
    facts = facts.withColumns({"rec_table": F.lit("cover_fact"), "slug": F.substring("run_id", 16, 1000), "topic": topic, "key": F.col("fact_id").cast("string")})
    return units.points(facts, _CARRIED, ["fact_label", "fact_value", "fact_unit"], fact_statements)


def card_points(spark: SparkSession, d: str) -> DataFrame:
    cards = last_delivery(read(spark, d, "report_card").select("run_id", "key_metrics", "coverage_notes", "ingested_at"), ["run_id"])
    cards = cards.withColumns({"rec_table": F.lit("report_card"), "slug": F.substring("run_id", 16, 1000), "topic": F.lit(""), "key": F.col("run_id")})
    return units.points(cards, _CARRIED, ["coverage_notes", *[f"key_metrics.{m}" for m in METRIC_KINDS]], card_statements)


def in_common_units(spark: SparkSession, d: str) -> DataFrame:
    """All stated quantities: rec_table, rec_key, field, std_unit, std_value, and what the history says of each."""
    every = fact_points(spark, d).unionByName(card_points(spark, d))
    both = units.unit_histories(every, ["rec_table", "slug", "topic"], ["run_id", "key"], ["rec_table", "key", "run_id", "slug"], known={m: _NOTED[k] for m, k in METRIC_KINDS.items()})
    rates = read(spark, d, "fx_rate").select(F.col("currency_code").alias("currency"), F.col("rate_year").cast("string").alias("year"), F.col("usd_per_unit").cast("decimal(14,9)").alias("rate"))
    known = both.withColumn("year", F.substring("run_id", 1, 4)).join(F.broadcast(rates), ["currency", "year"], "left")
    amount = F.expr("try_cast(try_cast(number as decimal(28,9)) * try_cast(factor as decimal(24,10)) as decimal(28,9))")
    value = F.round(amount * F.when(F.col("currency").isNull(), F.lit(1).cast("decimal(14,9)")).otherwise(F.col("rate")), 0)
    return known.select("rec_table", F.col("key").alias("rec_key"), "field", "std_unit", value.try_cast("bigint").alias("std_value"), "slug", "run_id", "currency", "stated", "segment", "shift")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity in its segment's unit. TESTDATA counts facts only where a text states the unit, and cards always."""
    return in_common_units(spark, d).filter("(stated or rec_table = 'report_card') and std_value is not null").select("rec_table", "rec_key", "field", "std_unit", "std_value")


def p1_unit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Where a source history's recorded level shifts by a known factor."""
    return in_common_units(spark, d).filter("shift is not null").select("rec_table", "rec_key", "field", "slug", "segment", "shift")


QUERIES = {"p1_found": p1_found, "p1_unit_changes": p1_unit_changes}
SQL: dict[str, str] = {}
