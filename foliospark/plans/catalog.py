"""Queries of the catalog's own operators on the report tables and the star tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import classify, coerce, text
from foliospark.operators import flatten, links, ranking, rollups
from foliospark.sources import feeds
from foliospark.streaming import schedule
from foliospark.tables import last_delivery, read

_LAST = "(select * from (select *, row_number() over (partition by {k} order by ingested_at desc nulls last) rn from {t}) where rn = 1)"
_CARDS = "with cards as (select * from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last, revision.status desc nulls last) rn from report_card) where rn = 1), cur as (select * from cards where revision.status is distinct from 'superseded')"
_LIVE = "(select * from " + _LAST + " where deleted_at is null)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def cards(s: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    """Each run's last delivery: run_id, ingested_at, revision (of which only the status is read) and what ``columns`` names; no other column leaves the scan.

    Of deliveries at one moment the one with the later status holds, in all queries of cards alike.
    """
    src = read(s, d, "report_card").select("run_id", "ingested_at", *columns, *([] if "revision" in columns else [F.struct("revision.status").alias("revision")]))
    return last_delivery(src, ["run_id"], ties=[F.col("revision.status")])


def current(s: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    return ranking.current(cards(s, d, *columns), F.col("revision.status"))


def live(s: SparkSession, d: str, table: str, key: str, *columns: str) -> DataFrame:
    return last_delivery(read(s, d, table).select(key, "ingested_at", "deleted_at", *columns), [key]).filter("deleted_at is null")


@query("current_filter", _CARDS + " select run_id, revision.status status from cur")
def current_filter(s, d):
    return current(s, d).select("run_id", F.col("revision.status").alias("status"))


@query("newest", _CARDS + " select run_id, substr(run_id, 1, 14) run_ts, headline from cur order by 2 desc, 1 desc limit 12")
def newest(s, d):
    c = current(s, d, "headline").select("run_id", F.substring("run_id", 1, 14).alias("run_ts"), "headline")
    return ranking.newest(c, "run_ts", "run_id", 12)


@query("newest_offset", _CARDS + " select run_id, substr(run_id, 1, 14) run_ts from cur order by 2 desc, 1 desc limit 12 offset 3")
def newest_offset(s, d):
    return ranking.newest(current(s, d).select("run_id", F.substring("run_id", 1, 14).alias("run_ts")), "run_ts", "run_id", 12, 3)


@query("top_rated", _CARDS + ", t as (select run_id, overall_score score, substr(run_id, 1, 14) run_ts from cur order by 2 desc, 3 desc, 1 desc limit 3) select run_id, score, run_ts, '#' || row_number() over (order by score desc, run_ts desc, run_id desc) rank_label from t")
def top_rated(s, d):
    c = current(s, d, "overall_score").select("run_id", F.coalesce(coerce.finite(F.col("overall_score")), F.lit(0.0)).alias("score"), F.substring("run_id", 1, 14).alias("run_ts"))
    return ranking.leaders(c, [F.desc("score"), F.desc("run_ts"), F.desc("run_id")]).drop("rank")


@query("ranking_rest", _CARDS + ", t as (select run_id, overall_score score, row_number() over (order by overall_score desc, run_id desc) k from cur) select run_id, score from t where k > 3 or (select count(*) from t) <= 3")
def ranking_rest(s, d):
    c = current(s, d, "overall_score").select("run_id", F.col("overall_score").alias("score"))
    return ranking.rest(c, "run_id", [F.desc("score"), F.desc("run_id")])


@query("site_totals", _CARDS + " select count(*) n, sum(source_stats.sources_retained) total, round(avg(overall_score), 6) mean, max(overall_score) top, count_if(recommendation = 'track') flagged from cur")
def site_totals(s, d):
    c = current(s, d, "overall_score", "source_stats", "recommendation")
    t = rollups.totals(c, F.col("overall_score"), F.col("source_stats.sources_retained"), F.col("recommendation") == "track")
    return t.withColumn("mean", F.round("mean", 6))


_MONTHS = _CARDS + ", m as (select substr(run_date, 1, 7) as month, count(*) n, sum(source_stats.sources_retained) total, round(avg(overall_score), 6) mean, max(substr(run_id, 1, 14)) latest from cur group by 1)"


def _months(s, d):
    c = current(s, d, "run_date", "overall_score", "source_stats").withColumn("run_ts", F.substring("run_id", 1, 14))
    return rollups.by_month(c, F.col("run_date"), "run_ts", F.col("overall_score"), F.col("source_stats.sources_retained")).withColumn("mean", F.round("mean", 6))


@query("archive_months", _MONTHS + " select * from m")
def archive_months(s, d):
    return _months(s, d).orderBy(F.desc("latest"))


@query("archive_summary", _MONTHS + " select count(*) n_months, max_by(month, latest) latest_label, max(latest) newest from m")
def archive_summary(s, d):
    return _months(s, d).agg(F.count("*").alias("n_months"), F.max_by("month", "latest").alias("latest_label"), F.max("latest").alias("newest"))


@query("archive_entries", _CARDS + " select substr(run_date, 1, 7) as month, run_id, row_number() over (partition by substr(run_date, 1, 7) order by run_id desc) as place from cur")
def archive_entries(s, d):
    c = current(s, d, "run_date").select(F.substring("run_date", 1, 7).alias("month"), "run_id")
    return ranking.top_per_group(c, "month", [F.desc("run_id")], None).withColumnRenamed("position", "place")


@query("newest_run_date", _CARDS + " select max_by(run_date, run_id) newest_date from cur")
def newest_run_date(s, d):
    return current(s, d, "run_date").agg(F.max_by("run_date", "run_id").alias("newest_date"))


_RE = lambda p: "(?i)" + "|".join(p)
_HITS = "list_filter([" + ", ".join(f"case when regexp_matches(sector, '{_RE(ps)}') then '{label}' end" for label, ps in classify.BUCKETS.items()) + "], lambda x: x is not null)"
_TAG = "case lower(p) " + " ".join(f"when '{k}' then '{v}'" for k, v in classify.FOCUS_TAGS.items()) + r""" else array_to_string(list_transform(string_split(p, ' '), lambda w: case lower(w) when 'ai' then 'AI' when 'saas' then 'SaaS' when 'hcm' then 'HCM' when 'it' then 'IT' else upper(w[1]) || lower(w[2:]) end), ' ') end"""
_SECTORS = _CARDS + rf""", sec as (select run_id, coalesce(company.sector, 'Other') sector, overall_score, source_stats.sources_retained sources, company.name as name from cur),
b0 as (select *, {_HITS} hits from sec), b as (select *, case when len(hits) > 0 then hits else ['Other'] end labels from b0),
x as (select run_id, overall_score, sources, name, unnest(labels) as label from b),
g as (select distinct run_id, sector, unnest(labels) as label, unnest([1]) one from b), gg as (select run_id, sector, unnest(labels) as label from b),
t0 as (select label, trim(regexp_replace(unnest(regexp_split_to_array(sector, '\s*/\s*|\s*&\s*')), '\s+', ' ', 'g')) p from gg), t as (select distinct label, {_TAG} tag from t0 where p <> ''),
tr as (select label, tag, row_number() over (partition by label order by lower(tag), tag desc) k from t),
tt as (select label, string_agg(tag, '|' order by k) filter (where k <= 6) first_tags, greatest(0, count(*) - 6)::bigint more_tags from tr group by label),
z as (select label, count(*) n, avg(overall_score) mean, sum(sources) total from x group by label)"""


def _sectors(s, d):
    c = current(s, d, "company", "overall_score", "source_stats").select("run_id", F.col("company.sector").alias("sector"), F.col("company.name").alias("name"), "overall_score", F.col("source_stats.sources_retained").alias("sources"))
    return c.withColumn("labels", classify.buckets(F.col("sector"))).withColumn("tags", classify.focus_tags(F.col("sector")))


@query("sector_rollup", _SECTORS + """ select z.label, regexp_replace(regexp_replace(lower(z.label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug, n, round(mean, 6) mean, total, first_tags, more_tags,
 lpad(row_number() over (order by n desc, mean desc, lower(z.label))::varchar, 2, '0') rank_label, floor(100.0 * n / max(n) over () + 0.5)::bigint share, row_number() over (order by n desc, mean desc, lower(z.label)) <= 4 featured from z join tt using (label)""")
def sector_rollup(s, d):
    return rollups.by_label(_sectors(s, d), "run_id", F.col("labels"), F.col("tags"), "overall_score", "sources").withColumn("mean", F.round("mean", 6))


@query("sector_entries", _SECTORS + ", e as (select label, run_id, overall_score score, row_number() over (partition by label order by overall_score desc, substr(run_id, 1, 14) desc, lower(name), run_id) as place, count(*) over (partition by label) n from x) select label, run_id, score, place, greatest(0, n - 6) more from e where place <= 6")
def sector_entries(s, d):
    rows = _sectors(s, d).select("run_id", F.col("overall_score").alias("score"), "name", F.explode("labels").alias("label"))
    first = ranking.top_per_group(rows, "label", [F.desc("score"), F.desc(F.substring("run_id", 1, 14)), F.collate("name", "UNICODE"), "run_id"], 6).withColumnRenamed("position", "place")
    sizes = rows.groupBy("label").agg(F.greatest(F.lit(0), F.count("*") - 6).alias("more"))
    return first.join(sizes, "label").select("label", "run_id", "score", "place", "more")


@query("multi_sector", _SECTORS + " select count_if(len(labels) > 1) multi, count(distinct sector) distinct_sectors from b")
def multi_sector(s, d):
    return _sectors(s, d).agg(F.count_if(F.size("labels") > 1).alias("multi"), F.countDistinct(F.coalesce("sector", F.lit("Other"))).alias("distinct_sectors"))


@query("focus_tags", _SECTORS + f", q as (select run_id, sector, unnest(regexp_split_to_array(sector, '\\s*/\\s*|\\s*&\\s*')) p from sec) select distinct sector, {_TAG} tag from q where p <> ''")
def focus_tags(s, d):
    return _sectors(s, d).select(F.coalesce("sector", F.lit("Other")).alias("sector"), F.explode("tags").alias("tag")).distinct()


@query("search_contains", _CARDS + " select run_id, company.name title from cur where contains(lower(company.name), 'net') order by run_id desc limit 30")
def search_contains(s, d):
    hits = ranking.contains(current(s, d, "company"), F.col("company.name"), " Net ")
    return ranking.newest(hits.select("run_id", F.col("company.name").alias("title")), "run_id", "title", 30)


@query("highlight", "select p_partkey, regexp_replace(replace(p_name, '&', '&amp;'), '(?i)(ing)', '<mark>\\1</mark>', 'g') html from part")
def highlight(s, d):
    return read(s, d, "part").select("p_partkey", text.highlight(F.col("p_name"), "ing").alias("html"))


_FOLDER = "substr(run_id, 16) || '-' || substr(sha1(run_id), 1, 6)"


@query("run_id_parts", f"select run_id, case when regexp_matches(run_id, '^[0-9]{{14}}-.+$') then substr(run_id, 1, 14) else '00000000000000' end run_ts, case when regexp_matches(run_id, '^[0-9]{{14}}-.+$') then substr(run_id, 16) else run_id end || '-' || substr(sha1(run_id), 1, 6) folder_slug from (select distinct run_id from evidence_source)")
def run_id_parts(s, d):
    stamp, folder = coerce.run_parts(F.col("run_id"))
    return read(s, d, "evidence_source").select("run_id").distinct().select("run_id", stamp.alias("run_ts"), folder.alias("folder_slug"))


def _foldered(df):
    return df.withColumn("folder_slug", coerce.run_parts(F.col("run_id"))[1])


@query("search_documents", _CARDS + f" select '/zh/' || {_FOLDER} || '/' href, company.name title, coalesce(company.sector, '') sector, overall_score rating, run_date date, lower(company.name) search_text from cur")
def search_documents(s, d):
    return feeds.search_documents(_foldered(current(s, d, "company", "overall_score", "run_date")), "/", "zh")


@query("sitemap", _CARDS + f", p as (select unnest(['/', '/archive/', '/sectors/', '/top-rated/', '/search/']) as path union all select '/' || {_FOLDER} || '/' from cards) select 'https://example.org' || l || path loc, '<url><loc>https://example.org' || l || path || '</loc></url>' xml from p, (values (''), ('/zh')) v(l)")
def sitemap(s, d):
    return feeds.sitemap(_foldered(cards(s, d).select("run_id")), "https://example.org/")


_CLEAN = "nullif(regexp_extract(lower(trim({c})), '([0-9]{{14}}-[^/]+)', 1), '')"


@query("redirect_routes", _CARDS + ", p as (select run_id, " + _CLEAN.format(c="revision.superseded_by_run_id") + " to_run from cards) select l || substr(run_id, 16) || '-' || substr(sha1(run_id), 1, 6) || '/' route, '/site' || l || substr(to_run, 16) || '-' || substr(sha1(to_run), 1, 6) || '/' target from p, (values ('/'), ('/zh/')) v(l) where to_run is not null")
def redirect_routes(s, d):
    from foliospark.plans.problems import clean_run

    c = cards(s, d, "revision").select(F.col("run_id").alias("from_run"), clean_run(F.col("revision.superseded_by_run_id")).alias("to_run")).filter("to_run is not null")
    return feeds.redirect_routes(c, "/site/")


@query("slugify", "select name, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'tag') slug from (select distinct publisher as name from evidence_source)")
def slugify(s, d):
    return read(s, d, "evidence_source").select(F.col("publisher").alias("name")).distinct().select("name", text.tag_slug(F.col("name")).alias("slug"))


_EN = "case lower({c}) " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in text.ENUM_LABELS.items()) + " else array_to_string(list_transform(string_split_regex({c}, '[-_]+'), lambda w: upper(w[1]) || w[2:]), ' ') end"
_ZH = "case lower({c}) " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in text.ENUM_LABELS.items()) + " else {c} end"


@query("display_label", f"with v as (select distinct unnest([recommendation, confidence, risk_rating, valuation_stance, revision.status]) v from report_card) select v, coalesce({_EN.format(c='v')}, '') en, coalesce({_ZH.format(c='v')}, '') zh from v")
def display_label(s, d):
    v = read(s, d, "report_card").select(F.explode(F.array("recommendation", "confidence", "risk_rating", "valuation_stance", "revision.status")).alias("v")).distinct()
    return v.select("v", text.display_label(F.col("v")).alias("en"), text.display_label(F.col("v"), True).alias("zh"))


@query("display_cell", "select freshness, claim_type, count(*) n, case lower(trim(freshness)) when 'unknown' then '未知' when 'none' then '无' when 'tbd' then '待定' else freshness end cell from claim group by freshness, claim_type")
def display_cell(s, d):
    return read(s, d, "claim").groupBy("freshness", "claim_type").agg(F.count("*").alias("n")).withColumn("cell", text.display_cell(F.col("freshness")))


def _fmt(v):
    return f"regexp_replace(format('{{:,.1f}}', round({v}::decimal(38,12), 1)), '\\.0$', '')"


_MONEY = "case when abs(v) >= 1000 then '$' || " + _fmt("(v / 1000)") + " || 'B' else '$' || " + _fmt("v") + " || 'M' end"


_PCT = "regexp_replace(regexp_replace(format('{:,.3f}', round(v::decimal(38,12), 3)), '0+$', ''), '\\.$', '') || '%'"


@query("metric_rows", _CARDS + f", u as (select run_id, unnest(['Valuation', 'Revenue', 'ARR', 'Growth', 'NRR']) as label, unnest([key_metrics.valuation_usd_m, key_metrics.revenue_run_rate_usd_m, key_metrics.arr_usd_m, key_metrics.revenue_growth_yoy_pct, key_metrics.nrr_pct]) v from cur) select run_id, label, case when label in ('Growth', 'NRR') then {_PCT} else {_MONEY} end as shown from u where v is not null and not isnan(v)")
def metric_rows(s, d):
    """The five metrics that a card shows, rows without a value removed."""
    row = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("shown"))
    m = lambda k: text.money_m(F.col(f"key_metrics.{k}"))
    p = lambda k: text.metric(F.col(f"key_metrics.{k}"), "%")
    shown = [row("Valuation", m("valuation_usd_m")), row("Revenue", m("revenue_run_rate_usd_m")), row("ARR", m("arr_usd_m")), row("Growth", p("revenue_growth_yoy_pct")), row("NRR", p("nrr_pct"))]
    rows = F.filter(F.array(*shown), lambda r: r["shown"].isNotNull())
    return current(s, d, "key_metrics").select("run_id", F.explode(rows).alias("r")).select("run_id", "r.label", "r.shown")


@query("percent_rows", _CARDS + ", u as (select run_id, key_metrics.nrr_pct v from cur) select run_id, regexp_replace(regexp_replace(format('{:,.3f}', round(v::decimal(38,12), 3)), '0+$', ''), '\\.$', '') || '%' as nrr from u where v is not null and not isnan(v)")
def percent_rows(s, d):
    return current(s, d, "key_metrics").select("run_id", text.metric(F.col("key_metrics.nrr_pct"), "%").alias("nrr")).filter("nrr is not null")


@query("fixed_scores")
def fixed_scores(s, d):
    """SQL engines round binary halves their own way, so this has no SQL and is tested on fixed cases."""
    return current(s, d, "overall_score").groupBy(F.substring("run_id", 1, 6).alias("month")).agg(F.avg("overall_score").alias("mean")).select("month", text.to_fixed_1(F.col("mean")).alias("shown"))


@query("typed_coerce", "select event_id, coalesce(try_cast(json_extract(props, '$.k') as double), 0.0) k, coalesce(json_extract_string(props, '$.missing'), 'none') missing from events")
def typed_coerce(s, d):
    v = F.try_parse_json("props")
    return read(s, d, "events").select("event_id", F.coalesce(coerce.number_or_null(coerce.get(v, "$.k")), F.lit(0.0)).alias("k"), coerce.string_or(coerce.get(v, "$.missing"), "none").alias("missing"))


@query("normalised_cards", _CARDS + """ select run_id, coalesce(slug, run_id) slug, coalesce(nullif(company.name, ''), 'Unknown company') as name, case when revision.status = 'superseded' then 'superseded' else 'current' end status,
 coalesce(case when not isnan(key_metrics.nrr_pct) then key_metrics.nrr_pct end, -1) nrr, len(top_strengths) strengths, coalesce(overall_score, 0) score from cards""")
def normalised_cards(s, d):
    """P7 on the cards as dynamic records: to variant, and back through the total projection."""
    rename = {"valuation_usd_m": "valuationUsdM", "nrr_pct": "nrrPct"}
    doc = F.struct(
        "slug", F.col("run_date").alias("runDate"), F.struct(F.col("company.name").alias("name"), F.col("company.sector").alias("sector")).alias("company"), F.struct(F.col("revision.status").alias("status")).alias("revision"),
        F.struct("headline", "recommendation", F.col("overall_score").alias("overallScore"), F.struct(*[coerce.finite(F.col(f"key_metrics.{k}")).alias(v) for k, v in rename.items()]).alias("keyMetrics"), F.col("top_strengths").alias("topStrengths")).alias("summary"),
    )
    raw = cards(s, d, "slug", "run_date", "company", "headline", "recommendation", "overall_score", "key_metrics", "top_strengths").select("run_id", F.parse_json(F.to_json(doc)).alias("doc"))
    n = coerce.report_cards(raw)
    return n.select("run_id", "slug", F.col("company.name").alias("name"), F.col("revision.status").alias("status"), F.coalesce("key_metrics.nrrPct", F.lit(-1.0)).alias("nrr"), F.size("top_strengths").cast("bigint").alias("strengths"), F.col("overall_score").alias("score"))


@query("extract_refs", r"with t as (select doc_id, regexp_extract_all(text, '\[(C[A-Z][0-9]{3})\]', 1) r from documents where text is not null) select doc_id, unnest(r) ref, unnest(range(len(r))) as pos from t where len(r) > 0")
def extract_refs(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(text.refs(F.col("text"))).alias("pos", "ref")).select("doc_id", "ref", F.col("pos").cast("bigint").alias("pos"))


@query("ref_parts", r"with t as (select doc_id, regexp_extract_all(text, '\[(C[A-Z][0-9]{3})\]', 1) r, string_split_regex(text, '\[C[A-Z][0-9]{3}\]') t from documents where text is not null) select doc_id, greatest(1, len(r) + len(list_filter(t, lambda x: x <> '')))::bigint parts, array_to_string(t, '') words from t")
def ref_parts(s, d):
    p = read(s, d, "documents").filter("text is not null").select("doc_id", text.ref_parts(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("parts"), F.array_join(F.transform(F.filter("p", lambda x: x["kind"] == "text"), lambda x: x["value"]), "").alias("words"))


@query("strip_trailing_refs", r"select claim_key, ingested_at, trim(regexp_replace(statement || ' [CO001] [CM002].', '(?:\s*\[C[A-Z][0-9]{3}\])+\.?$', '.')) clean from claim where statement is not null")
def strip_trailing_refs(s, d):
    return read(s, d, "claim").filter("statement is not null").select("claim_key", "ingested_at", text.strip_trailing_refs(F.concat("statement", F.lit(" [CO001] [CM002]."))).alias("clean"))


_CLAIMS = "claims as " + _LIVE.format(k="claim_key", t="claim")
_BLOCKS = "blocks as " + _LAST.format(k="block_key", t="report_block")
_EXHIBITS = "exhibits as " + _LIVE.format(k="exhibit_key", t="exhibit")
_SOURCES = "sources as " + _LIVE.format(k="source_key", t="evidence_source")


def blocks(s, d, *columns):
    return last_delivery(read(s, d, "report_block").select("block_key", "run_id", "ingested_at", *columns), ["block_key"])


@query("claim_lookup", f"with {_CLAIMS}, {_BLOCKS}, r as (select block_key, run_id, unnest(claim_refs) claim_id from blocks) select block_key, r.claim_id, coalesce(statement, r.claim_id) shown from r left join claims using (run_id, claim_id) where r.claim_id is not null")
def claim_lookup(s, d):
    r = blocks(s, d, "claim_refs").select("block_key", "run_id", F.explode("claim_refs").alias("claim_id")).filter("claim_id is not null")
    c = live(s, d, "claim", "claim_key", "run_id", "claim_id", "statement")
    return links.looked_up(r, c, ["run_id", "claim_id"], "statement", "claim_id", "shown").select("block_key", "claim_id", "shown")


@query("block_exhibits", f"with {_BLOCKS}, {_EXHIBITS} select block_key, exhibit_key, exhibit_kind from blocks b join exhibits e on e.run_id = b.run_id and e.exhibit_id = case e.exhibit_kind when 'table' then b.table_ref else b.figure_ref end")
def block_exhibits(s, d):
    b = blocks(s, d, "table_ref", "figure_ref").select("block_key", "run_id", F.explode(F.array(F.struct(F.lit("table").alias("exhibit_kind"), F.col("table_ref").alias("exhibit_id")), F.struct(F.lit("figure").alias("exhibit_kind"), F.col("figure_ref").alias("exhibit_id")))).alias("r")).select("block_key", "run_id", "r.*")
    return b.join(live(s, d, "exhibit", "exhibit_key", "run_id", "exhibit_id", "exhibit_kind"), ["run_id", "exhibit_kind", "exhibit_id"]).select("block_key", "exhibit_key", "exhibit_kind")


@query("revision_targets", _CARDS + ", p as (select run_id, " + _CLEAN.format(c="revision.refresh_of_run_id") + f" target from cards) select p.run_id, target, case when c.run_id is not null then substr(target, 16) || '-' || substr(sha1(target), 1, 6) end target_slug from p left join cards c on c.run_id = p.target")
def revision_targets(s, d):
    """The slug of a linked run, only where that run exists."""
    from foliospark.plans.problems import clean_run

    c = cards(s, d, "revision")
    known = c.select(F.col("run_id").alias("target"), coerce.run_parts(F.col("run_id"))[1].alias("target_slug"))
    return c.select("run_id", clean_run(F.col("revision.refresh_of_run_id")).alias("target")).join(known, "target", "left").select("run_id", "target", "target_slug")


@query("stage_bundle", _CARDS + f", {_CLAIMS}, {_SOURCES}, {_BLOCKS}, c as (select run_id, count(*) claims from claims group by 1), s as (select run_id, count(*) sources from sources group by 1), b as (select run_id, count(*) blocks from blocks group by 1) select run_id, claims, sources, blocks from cur left join c using (run_id) left join s using (run_id) left join b using (run_id)")
def stage_bundle(s, d):
    """Each run's artifacts side by side, null where there is none. Parts are aggregated before they are joined."""
    out = current(s, d).select("run_id")
    for part, name in ((live(s, d, "claim", "claim_key", "run_id"), "claims"), (live(s, d, "evidence_source", "source_key", "run_id"), "sources"), (blocks(s, d), "blocks")):
        out = out.join(part.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left")
    return out


@query("orphan_exhibits", f"with {_EXHIBITS}, {_BLOCKS} select exhibit_key, run_id, exhibit_id from exhibits e where not exists (select 1 from blocks b where b.run_id = e.run_id and (b.table_ref = e.exhibit_id or b.figure_ref = e.exhibit_id))")
def orphan_exhibits(s, d):
    used = blocks(s, d, "table_ref", "figure_ref").select("run_id", F.explode(F.array("table_ref", "figure_ref")).alias("exhibit_id")).filter("exhibit_id is not null")
    return links.without(live(s, d, "exhibit", "exhibit_key", "run_id", "exhibit_id"), used, ["run_id", "exhibit_id"]).select("exhibit_key", "run_id", "exhibit_id")


@query("confidence_rule", f"with {_CLAIMS}, {_SOURCES}, r as (select distinct claim_key, run_id, unnest(source_refs) source_id from claims where confidence = 'high'), k as (select claim_key, count(*) n, count_if(reputation_tier = 'high') hi from r join sources using (run_id, source_id) group by 1) select claim_key, coalesce(n, 0) sources, coalesce(hi, 0) high from claims left join k using (claim_key) where confidence = 'high' and (coalesce(n, 0) < 2 or coalesce(hi, 0) < 1)")
def confidence_rule(s, d):
    """V3: high-confidence claims with fewer than two sources, or none of high reputation."""
    c = live(s, d, "claim", "claim_key", "run_id", "confidence", "source_refs").filter("confidence = 'high'")
    r = c.select("claim_key", "run_id", F.explode("source_refs").alias("source_id")).distinct()
    k = r.join(live(s, d, "evidence_source", "source_key", "run_id", "source_id", "reputation_tier"), ["run_id", "source_id"]).groupBy("claim_key").agg(F.count("*").alias("n"), F.count_if(F.col("reputation_tier") == "high").alias("hi"))
    return c.join(k, "claim_key", "left").select("claim_key", F.coalesce("n", F.lit(0)).alias("sources"), F.coalesce("hi", F.lit(0)).alias("high")).filter("sources < 2 or high < 1")


@query("prefix_mismatch", f"with {_BLOCKS}, r as (select block_key, chapter_number, unnest(claim_refs) ref from blocks) select distinct block_key, ref from r where ref is not null and regexp_matches(ref, '^C[A-Z][0-9]{{3}}$') and coalesce(strpos('OMPIEURV', ref[2]), 0) <> chapter_number")
def prefix_mismatch(s, d):
    """V6: references whose letter belongs to another chapter."""
    r = blocks(s, d, "chapter_number", "claim_refs").select("block_key", "chapter_number", F.explode("claim_refs").alias("ref")).filter(F.col("ref").rlike(r"^C[A-Z]\d{3}\z"))
    return r.filter(F.instr(F.lit("OMPIEURV"), F.substring("ref", 2, 1)) != F.col("chapter_number")).select("block_key", "ref").distinct()


@query("domain_count", f"with {_SOURCES}, h as (select run_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\\.)?([^/:?#]+)', 1), '') h from sources) select run_id, count(distinct h) domains, count(h) with_url from h group by 1")
def domain_count(s, d):
    c = live(s, d, "evidence_source", "source_key", "run_id", "url").withColumn("h", text.host(F.col("url")))
    return c.groupBy("run_id").agg(F.countDistinct("h").alias("domains"), F.count("h").alias("with_url"))


@query("digest", "select doc_id, sha1(('3'::blob) || '\\x00'::blob || encode(text)) digest from documents where text is not null")
def digest(s, d):
    return read(s, d, "documents").filter("text is not null").select("doc_id", links.digest(F.col("text"), "3").alias("digest"))


@query("manifest_actions", """with o as (select claim_key, first(sha1(concat_ws('|', statement, confidence)) order by ingested_at) was from claim group by 1),
n as (select claim_key, sha1(concat_ws('|', statement, confidence)) now, deleted_at from (select *, row_number() over (partition by claim_key order by ingested_at desc nulls last) rn from claim) where rn = 1)
select claim_key, case when deleted_at is not null then 'pruned' when was = now then 'reused' else 'loaded' end as action from o join n using (claim_key)""")
def manifest_actions(s, d):
    """The first delivery of each claim as the store, the last as what is seen, deleted claims as gone."""
    c = read(s, d, "claim").withColumn("digest", F.sha1(F.concat_ws("|", "statement", "confidence").cast("binary")))
    stored = c.groupBy("claim_key").agg(F.min_by("digest", "ingested_at").alias("digest"))
    seen = last_delivery(c.select("claim_key", "digest", "ingested_at", "deleted_at"), ["claim_key"]).filter("deleted_at is null")
    return links.manifest_actions(stored, seen, "claim_key").select("claim_key", "action")


@query("refresh_counters", "with a as (" + SQL["manifest_actions"] + ") select action, count(*) n from a group by 1")
def refresh_counters(s, d):
    return manifest_actions(s, d).groupBy("action").agg(F.count("*").alias("n"))


_ZHDOC = "z as (select run_id, max_by(text, doc_id) zh from documents where run_id is not null and artifact = 'card-headline' and lower(substr(lang, 1, 2)) = 'zh' group by 1)"


def _overlay(s, d):
    return read(s, d, "documents").filter("run_id is not null and artifact = 'card-headline' and lower(substring(lang, 1, 2)) = 'zh'").groupBy("run_id").agg(F.max_by("text", "doc_id").alias("zh"))


@query("feed_items", _CARDS + f", {_ZHDOC}, l as (select unnest(['', '/zh']) prefix) select company.name title, case when prefix = '/zh' then coalesce(case when regexp_replace(zh, '^\\s+|\\s+$', '', 'g') <> '' then zh end, headline) else headline end description, run_date pub_date, prefix || '/' || {_FOLDER} || '/' link from cur left join z using (run_id), l")
def feed_items(s, d):
    """Every current card, newest first, in the feeds of both locales; the Chinese one has the overlay's headline where there is one."""
    c = _foldered(current(s, d, "company", "headline", "run_date")).withColumn("locale", F.explode(F.array(F.lit("en"), F.lit("zh"))))
    zh = _overlay(s, d).withColumnRenamed("zh", "zh_headline").withColumn("locale", F.lit("zh"))
    told = c.join(zh, ["run_id", "locale"], "left").withColumn("headline", F.coalesce(links.present(F.col("zh_headline")), F.col("headline")))
    return feeds.feed_items(ranking.newest(told, "run_id", "locale"), F.col("locale"))


@query("overlay_coalesce", _CARDS + f", {_ZHDOC} select run_id, coalesce(case when trim(zh) <> '' then zh end, headline) headline from cur left join z using (run_id)")
def overlay_coalesce(s, d):
    return links.overlaid(current(s, d, "headline").select("run_id", "headline"), _overlay(s, d), "run_id", {"headline": "zh"})


@query("untranslated", _CARDS + f", {_ZHDOC} select run_id from cur where not exists (select 1 from z where z.run_id = cur.run_id)")
def untranslated(s, d):
    return links.without(current(s, d).select("run_id"), _overlay(s, d), ["run_id"])


@query("lookup_with_fallback", "select c_custkey, coalesce(n_name, c_nationkey::varchar) nation from customer left join nation on n_nationkey = c_nationkey")
def lookup_with_fallback(s, d):
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return links.looked_up(read(s, d, "customer"), n, ["c_nationkey"], "n_name", "c_nationkey", "nation").select("c_custkey", "nation")


@query("due_jobs", "with h as (select unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), interval 1 hour)) due_at from events), r as (select due_at, unnest(list_filter([case when hour(due_at) % 6 = 0 then 'research' end, case when hour(due_at) % 2 = 0 then 'translate' end, case when hour(due_at) = 2 then 'refresh' end], lambda x: x is not null)) job from h) select due_at, job from r")
def due_jobs(s, d):
    return schedule.due_between(read(s, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "a", "b").withColumnRenamed("at", "due_at")


@query("events_due", "select event_id, hour(ts) as hour_utc, minute(ts) = 0 and hour(ts) % 2 = 0 as due from events")
def events_due(s, d):
    return read(s, d, "events").select("event_id", F.hour("ts").cast("bigint").alias("hour_utc"), F.array_contains(schedule.due(F.col("ts")), "translate").alias("due"))


@query("templates", "select n_nationkey, replace('{n} in {unknown}', '{n}', coalesce(n_name, '')) line, (n_regionkey::varchar || ' ' || case when n_regionkey = 1 then 'report' else 'reports' end) counted from nation")
def templates(s, d):
    return read(s, d, "nation").select("n_nationkey", text.fill(F.lit("{n} in {unknown}"), n=F.col("n_name")).alias("line"), text.plural(F.col("n_regionkey"), "report", "reports").alias("counted"))


@query("dictionary", "with t(key, en, zh) as (values ('1-URGENT', 'Urgent', '紧急'), ('5-LOW', 'Low', null)) select o_orderpriority as key, count(*) n, coalesce(zh, en, o_orderpriority) label from orders left join t on t.key = o_orderpriority group by 1, 3")
def dictionary(s, d):
    """A dictionary lookup in one language, then the other, then the key itself."""
    t = s.createDataFrame([("1-URGENT", "Urgent", "紧急"), ("5-LOW", "Low", None)], "key string, en string, zh string")
    o = read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"))
    return o.join(t, "key", "left").select("key", "n", F.coalesce("zh", "en", "key").alias("label"))


@query("table_cells", f"with {_SOURCES} select source_key, p - 1 as pos, topics[p] cell, case p when 1 then 'First' when 2 then 'Second' end header from sources, lateral (select unnest(generate_series(1, len(topics))) p)")
def table_cells(s, d):
    c = live(s, d, "evidence_source", "source_key", "topics")
    return links.cells_with_headers(c, ["source_key"], "topics", ["First", "Second"]).select("source_key", F.col("pos").cast("bigint").alias("pos"), "cell", "header")


@query("locale_paths", _CARDS + f" select run_id, '/base/zh/' || {_FOLDER} || '/' zh_path, '/base/' || {_FOLDER} || '/' en_path, '/base/zh/rss.xml' feed from cur")
def locale_paths(s, d):
    c = _foldered(current(s, d))
    p = lambda lang: text.locale_path(F.lit("//base/"), F.lit(lang), F.col("folder_slug"))
    return c.select("run_id", p("zh").alias("zh_path"), p("en").alias("en_path"), text.locale_file(F.lit("/base"), F.lit("zh"), "rss.xml").alias("feed"))


@query("source_dates", "with t as (select distinct source_date t from evidence_source) select t, case when regexp_matches(t, '^[0-9]{4}-[0-9]{2}$') then t else coalesce(strftime(try_strptime(t, '%Y-%m-%d'), '%Y-%m-%d'), strftime(try_strptime(t, '%d %b %Y'), '%Y-%m-%d')) end iso from t")
def source_dates(s, d):
    return read(s, d, "evidence_source").select(F.col("source_date").alias("t")).distinct().select("t", text.iso_date(F.col("t")).alias("iso"))


@query("callouts", f"with {_BLOCKS} select block_key, 'callout-' || coalesce(nullif(regexp_replace(lower(callout_type), '[^a-z0-9-]', '', 'g'), ''), 'note') class, trim(regexp_replace('<b>' || body || '</b>', '<[^>]+>', '', 'g')) plain from blocks where block_type = 'callout'")
def callouts(s, d):
    b = blocks(s, d, "block_type", "callout_type", "body").filter("block_type = 'callout'")
    return b.select("block_key", text.callout_class(F.col("callout_type")).alias("class"), text.strip_tags(F.concat(F.lit("<b>"), "body", F.lit("</b>"))).alias("plain"))


@query("refs_for_footer", f"with {_BLOCKS} select block_key, case when regexp_matches(coalesce(body, ''), '\\[(C[A-Z][0-9]{{3}})\\]') then 0 else coalesce(len(claim_refs), 0) end footer_refs from blocks")
def refs_for_footer(s, d):
    """A block's own references show in the footer only where its text has none inline."""
    b = blocks(s, d, "body", "claim_refs")
    return b.select("block_key", F.when(text.has_refs(F.col("body")), 0).otherwise(F.coalesce(F.size("claim_refs"), F.lit(0))).cast("bigint").alias("footer_refs"))


@query("running_runs", _MONTHS + " select month, n, sum(n) over (order by month) so_far from m")
def running_runs(s, d):
    return ranking.running_total(_months(s, d).select("month", "n"), [], "month", "n", "so_far")


@query("short_notes", _CARDS + " select run_id, length(coverage_notes) note_length from cur where length(coverage_notes) <= 40")
def short_notes(s, d):
    """Notes too short to state a basis."""
    return current(s, d, "coverage_notes").select("run_id", F.length("coverage_notes").cast("bigint").alias("note_length")).filter("note_length <= 40")


@query("enum_drift", "select field, value, count(*) n from (select unnest(['recommendation', 'confidence', 'risk_rating', 'valuation_stance', 'revision.status']) field, unnest([recommendation, confidence, risk_rating, valuation_stance, revision.status]) as value from report_card) where value is null or value not in ('buy', 'pass', 'track', 'avoid', 'research-more', 'high', 'medium', 'low', 'unknown', 'stretched', 'fair', 'expensive', 'cheap') group by 1, 2")
def enum_drift(s, d):
    """P10: values outside the known labels, for each field."""
    v = read(s, d, "report_card").select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("recommendation", "confidence", "risk_rating", "valuation_stance", "revision.status")])).alias("x")).select("x.*")
    return v.filter(F.col("value").isNull() | ~F.col("value").isin(list(text.ENUM_LABELS))).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("claim_edges", f"with {_CLAIMS}, {_BLOCKS}, {_EXHIBITS}, e as (select 'claim-source' relation, run_id, unnest(source_refs) ref from claims union all select 'block-claim', run_id, unnest(claim_refs) from blocks union all select 'exhibit-claim', run_id, unnest(claim_refs) from exhibits) select relation, run_id, count(*) edges, count(distinct ref) targets from e where ref is not null group by 1, 2")
def claim_edges(s, d):
    """All reference relations as one edge table, counted by run."""
    e = lambda df, name, refs: df.select(F.lit(name).alias("relation"), "run_id", F.explode(refs).alias("ref"))
    all_edges = e(live(s, d, "claim", "claim_key", "run_id", "source_refs"), "claim-source", "source_refs").unionByName(e(blocks(s, d, "claim_refs"), "block-claim", "claim_refs")).unionByName(e(live(s, d, "exhibit", "exhibit_key", "run_id", "claim_refs"), "exhibit-claim", "claim_refs"))
    return all_edges.filter("ref is not null").groupBy("relation", "run_id").agg(F.count("*").alias("edges"), F.countDistinct("ref").alias("targets"))


@query("failed_messages", "with e as (select *, row_number() over (partition by user_id order by event_id) - 1 k, count(*) over (partition by user_id) n from events where event_type = 'error') select user_id, (k // 1000)::int part, max(n) failures, string_agg(event_type || ':' || event_id, '; ' order by event_id) message from e group by user_id, k // 1000")
def failed_messages(s, d):
    """All failures of each user, joined to messages of at most 1,000 lines that ``part`` numbers from 0; ``failures`` counts the user's.

    A hot user's failures are numbered in one sort, which spills; only a message's lines are ever collected.
    """
    e = read(s, d, "events").filter("event_type = 'error'").select("user_id", "event_id", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("t"))
    parts = ranking.top_per_group(e, "user_id", [F.col("event_id")], None).withColumn("part", F.expr("cast((position - 1) div 1000 as int)")).groupBy("user_id", "part")
    joined = parts.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "t"))), lambda x: x["t"]), "; ").alias("message"))
    return joined.select("user_id", "part", F.sum("n").over(Window.partitionBy("user_id")).alias("failures"), "message")


@query("plain_text")
def plain_text(s, d):
    """B7 over the unwrapped payloads, whole ($) and member by member: recursive, so beyond SQL; tested on fixed cases."""
    return flatten.plain_members(last_delivery(read(s, d, "full_report"), ["load_id"]), "load_id", "payload")
