"""Total coercion of dynamic records: only values of the right type pass, everything else falls back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.tables import BLANK, strip

_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_or_null(v: Column) -> Column:
    """A variant's string that isn't blank, untrimmed; numbers and booleans are no strings."""
    s = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(~s.rlike(rf"^{BLANK}*\z"), s)


def string_or(v: Column, fallback: Column | str) -> Column:
    return F.coalesce(string_or_null(v), F.lit(fallback) if isinstance(fallback, str) else fallback)


def number_or_null(v: Column) -> Column:
    """A variant's finite number; texts of digits are no numbers."""
    numeric = _kind(v).isin(*_NUMBERS) | _kind(v).startswith("DECIMAL")
    return finite(F.when(numeric, F.try_variant_get(v, "$", "double")))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def string_list(v: Column) -> Column:
    """The items of a variant array that are strings; an empty list for anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(items, lambda i: _kind(i) == "STRING"), lambda i: F.try_variant_get(i, "$", "string")), F.array().cast("array<string>"))


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


METRIC_KEYS = ["valuationUsdM", "revenueRunRateUsdM", "arrUsdM", "revenueGrowthYoYPct", "grossMarginPct", "nrrPct", "totalRaisedUsdM", "customerCount", "headcount"]
STAT_KEYS = ["sourcesRetained", "claimsReviewed", "domainCount", "adverseSourceCount", "openQuestionCount", "documentedGapQuestionCount", "blockingQuestionCount", "averageSourceAgeDays"]
COMPANY_KEYS = ["website", "sector", "stage", "headquarters", "shortDescription"]


def run_parts(run_id: Column) -> tuple[Column, Column]:
    """(timestamp, folder slug) of a run id; zeros and the whole id where it has no timestamp."""
    hit = run_id.rlike(r"^\d{14}-.+\z")
    stamp = F.when(hit, F.substring(run_id, 1, 14)).otherwise("0" * 14)
    name = F.when(hit, run_id.substr(F.lit(16), F.length(run_id))).otherwise(run_id)
    return stamp, F.concat(name, F.lit("-"), F.substring(F.sha1(run_id.cast("binary")), 1, 6))


def is_repository(x: Column) -> Column:
    """F8: whether a setting is owner/repo."""
    return F.coalesce(x.rlike(r"^[\w.-]+/[\w.-]+\z"), F.lit(False))


def is_measurement_id(x: Column) -> Column:
    """F8: whether a setting, without the white space around it, is a measurement id."""
    return F.coalesce(strip(x).rlike(r"^[Gg]-[A-Za-z0-9]+\z"), F.lit(False))


def report_cards(raw: DataFrame, run_id: str = "run_id", doc: str = "doc") -> DataFrame:
    """Raw card records (variant) as typed cards with every default in place. Undeclared keys are dropped.

    A null record gives the card of defaults. Links to other runs keep their text; ``revision_targets`` adds their slugs.
    """
    d, r = F.col(doc), F.col(run_id)
    stamp, folder = run_parts(r)
    name = string_or(get(d, "$.company.name"), "Unknown company")
    text = lambda p: string_or_null(get(d, p))
    rec = get(d, "$.summary.recommendation")
    return raw.select(
        r.alias("run_id"), stamp.alias("run_timestamp"), folder.alias("folder_slug"), F.lit("summary-card").alias("artifact"),
        string_or(get(d, "$.slug"), r).alias("slug"), string_or(get(d, "$.runDate"), "1970-01-01").alias("run_date"),
        F.struct(name.alias("name"), *[text(f"$.company.{k}").alias(k) for k in COMPANY_KEYS]).alias("company"),
        F.struct(
            F.when(text("$.revision.status") == "superseded", "superseded").otherwise("current").alias("status"),
            *[text(f"$.revision.{k}").alias(k) for k in ("refreshOfRunId", "supersededByRunId", "refreshReason")],
        ).alias("revision"),
        string_or(get(d, "$.summary.headline"), F.concat(name, F.lit(" diligence report"))).alias("headline"),
        F.coalesce(F.when(_kind(rec) == "STRING", F.try_variant_get(rec, "$", "string")), F.lit("research-more")).alias("recommendation"),
        string_or(get(d, "$.summary.confidence"), "low").alias("confidence"), string_or(get(d, "$.summary.riskRating"), "unknown").alias("risk_rating"),
        string_or(get(d, "$.summary.valuationStance"), "unknown").alias("valuation_stance"),
        F.coalesce(number_or_null(get(d, "$.summary.overallScore")), F.lit(0.0)).alias("overall_score"),
        F.struct(*[(number_or_null(get(d, f"$.sourceStats.{k}")) if k == "averageSourceAgeDays" else F.coalesce(number_or_null(get(d, f"$.sourceStats.{k}")), F.lit(0.0))).alias(k) for k in STAT_KEYS]).alias("source_stats"),
        F.struct(*[number_or_null(get(d, f"$.summary.keyMetrics.{k}")).alias(k) for k in METRIC_KEYS]).alias("key_metrics"),
        *[string_list(get(d, f"$.summary.{k}")).alias(n) for k, n in (("topStrengths", "top_strengths"), ("topRisks", "top_risks"), ("unresolvedGaps", "unresolved_gaps"))],
    )
