"""The pN_ queries of the core problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import flatten, hierarchy, history, references
from foliospark.tables import cut, last_delivery, read, strip

METRICS = [
    "valuation_usd_m", "revenue_run_rate_usd_m", "arr_usd_m", "revenue_growth_yoy_pct", "gross_margin_pct",
    "nrr_pct", "total_raised_usd_m", "customer_count", "headcount",
]


def run_slug(run_id="run_id"):
    return F.regexp_extract(run_id, r"^[0-9]{14}-(.+)\z", 1)


def _metric(name: str):
    m = F.col(f"key_metrics.{name}")
    return F.when(~F.isnan(m), m + 0.0).alias(name)


def metric_ledger(spark: SparkSession, d: str) -> DataFrame:
    cards = read(spark, d, "report_card").select(
        F.coalesce("slug", run_slug()).alias("slug"), F.substring("run_id", 1, 14).alias("run_ts"), "ingested_at", *map(_metric, METRICS)
    )
    return history.bitemporal_ledger(cards, "slug", "run_ts", "ingested_at", METRICS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    v = history.versions(metric_ledger(spark, d), METRICS)
    return v.select(F.col("entity").alias("slug"), "valid_from", F.coalesce("valid_to", F.lit("")).alias("valid_to"))


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return metric_ledger(spark, d).withColumnRenamed("entity", "slug")


def clean_run(link):
    """A link to a run in any written form, as the run_id: lower case, without folder, file name, slash and blanks."""
    return F.nullif(F.regexp_extract(F.lower(strip(link)), r"([0-9]{14}-[^/]+)", 1), F.lit(""))


def run_links(spark: SparkSession, d: str) -> DataFrame:
    """run_id and parent: the run that it refreshes, else the least run that says this one supersedes it."""
    cards = last_delivery(read(spark, d, "report_card").select("run_id", "revision", "ingested_at"), ["run_id"])
    cards = cards.select("run_id", clean_run(F.col("revision.refresh_of_run_id")).alias("up"), strip(F.col("revision.refresh_of_run_id")).alias("said"), clean_run(F.col("revision.superseded_by_run_id")).alias("by"))
    by = cards.filter("by is not null").groupBy(F.col("by").alias("run_id")).agg(F.min("run_id").alias("older"))
    return cards.join(by, "run_id", "left").select("run_id", F.when(F.coalesce("said", F.lit("")) != "", F.col("up")).otherwise(F.col("older")).alias("parent"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = hierarchy.nested_sets(run_links(spark, d), "run_id", "parent")
    return s.select(
        F.col("node").alias("run_id"), F.coalesce("root", F.lit("")).alias("root_run_id"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"),
        F.coalesce("descendants", F.lit(-1)).cast("long").alias("descendants"), F.coalesce("path", F.lit("")).alias("run_path"),
    )


def p3_nested_sets(spark: SparkSession, d: str) -> DataFrame:
    s = hierarchy.nested_sets(run_links(spark, d), "run_id", "parent")
    return s.select(F.col("node").alias("run_id"), "parent", "root", "lo", "hi", "cyclic")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    loads = last_delivery(read(spark, d, "full_report"), ["load_id"])
    flat = flatten.flatten_json(loads, ["run_id"], "payload", flatten.shape_report, flatten.REPORT)
    return flat.drop("label").dropDuplicates(["run_id", "node_path"])


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each run's last payload with what they say: title, type, text or cell value."""
    loads = last_delivery(read(spark, d, "full_report").filter("payload is not null"), ["run_id"])
    return flatten.flatten_json(loads, ["run_id"], "payload", flatten.shape_report, flatten.REPORT)


def reference_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references (ref_field, owner_key, scope, kind, ref) and all existing ids (scope, kind, id)."""
    claims = cut(last_delivery(read(spark, d, "claim").select("claim_key", "run_id", "claim_id", "source_refs", "ingested_at", "deleted_at"), ["claim_key"]).filter("deleted_at is null").drop("ingested_at", "deleted_at"))
    blocks = last_delivery(read(spark, d, "report_block").select("block_key", "run_id", "claim_refs", "table_ref", "figure_ref", "ingested_at"), ["block_key"])
    exhibits = last_delivery(read(spark, d, "exhibit").select("exhibit_key", "run_id", "exhibit_id", "exhibit_kind", "ingested_at", "deleted_at"), ["exhibit_key"]).filter("deleted_at is null")
    sources = last_delivery(read(spark, d, "evidence_source").select("source_key", "run_id", "source_id", "ingested_at", "deleted_at"), ["source_key"]).filter("deleted_at is null")
    field = lambda name, kind: F.struct(F.lit(name).alias("ref_field"), F.lit(kind).alias("kind"))
    of_claims = claims.select(F.explode("source_refs").alias("raw"), field("claim.source_refs", "source").alias("f"), F.col("claim_key").alias("owner_key"), "run_id")
    item = lambda raw, f: F.struct(raw.alias("raw"), f.alias("f"))
    of_blocks = blocks.select(
        "block_key", "run_id",
        F.explode(
            F.concat(
                F.transform(F.coalesce("claim_refs", F.array().cast("array<string>")), lambda r: item(r, field("report_block.claim_refs", "claim"))),
                F.array(item(F.col("table_ref"), field("report_block.table_ref", "table")), item(F.col("figure_ref"), field("report_block.figure_ref", "figure"))),
            )
        ).alias("e"),
    ).select("e.raw", "e.f", F.col("block_key").alias("owner_key"), "run_id")
    refs = of_claims.unionByName(of_blocks).select("f.ref_field", "f.kind", "owner_key", F.col("run_id").alias("scope"), references.clean_id(F.col("raw")).alias("ref")).filter("ref is not null")
    have = lambda df, key, kind: df.select(F.col("run_id").alias("scope"), kind.alias("kind"), references.clean_id(F.col(key)).alias("id"))
    ids = have(claims, "claim_id", F.lit("claim")).unionByName(have(sources, "source_id", F.lit("source"))).unionByName(have(exhibits, "exhibit_id", F.col("exhibit_kind")))
    return cut(refs), ids


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    refs, ids = reference_edges(spark, d)
    gone = references.missing_references(refs, ids)
    month = F.concat(F.substring("scope", 1, 4), F.lit("-"), F.substring("scope", 5, 2))
    return gone.select("ref_field", month.alias("run_month"), "owner_key", F.col("ref").alias("ref_id"))


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("ref_field", "run_month").agg(F.count("*").alias("dead_refs"), F.countDistinct("owner_key").alias("owners"))


QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger, "p3_found": p3_found, "p3_nested_sets": p3_nested_sets, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_orphans_by_month": p5_orphans_by_month}

_SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_TRIM = rf"^{_SP}+|{_SP}+$"
_IDTRIM = rf"^(?:{_SP}|[\[\](){{}}])+|(?:{_SP}|[\[\](){{}}])+$"
_PRINT = ", ".join(f"case when isnan(key_metrics.{m}) then null else key_metrics.{m} end" for m in METRICS)
_LAST = "row_number() over (partition by {k} order by ingested_at desc nulls last)"

_P5 = rf"""
with c as (select * from (select *, {_LAST.format(k="claim_key")} rn from claim) where rn = 1 and deleted_at is null),
b as (select * from (select *, {_LAST.format(k="block_key")} rn from report_block) where rn = 1),
e as (select * from (select *, {_LAST.format(k="exhibit_key")} rn from exhibit) where rn = 1 and deleted_at is null),
s as (select * from (select *, {_LAST.format(k="source_key")} rn from evidence_source) where rn = 1 and deleted_at is null),
ids as (select run_id, 'claim' kind, claim_id id from c union select run_id, 'source', source_id from s union select run_id, exhibit_kind, exhibit_id from e),
raw as (select 'claim.source_refs' ref_field, 'source' kind, claim_key owner_key, run_id, unnest(source_refs) r from c
 union all select 'report_block.claim_refs', 'claim', block_key, run_id, unnest(claim_refs) from b
 union all select 'report_block.table_ref', 'table', block_key, run_id, table_ref from b
 union all select 'report_block.figure_ref', 'figure', block_key, run_id, figure_ref from b),
refs as (select distinct ref_field, kind, owner_key, run_id, upper(regexp_replace(r, '{_IDTRIM}', '', 'g')) ref_id from raw where r is not null),
gone as (select ref_field, substr(run_id, 1, 4) || '-' || substr(run_id, 5, 2) run_month, owner_key, ref_id from refs
 where ref_id <> '' and not exists (select 1 from ids where ids.run_id = refs.run_id and ids.kind = refs.kind and upper(ids.id) = refs.ref_id))
"""

_P3 = rf"""
with recursive r as (select run_id, regexp_replace(revision.refresh_of_run_id, '{_TRIM}', '', 'g') said, regexp_replace(revision.superseded_by_run_id, '{_TRIM}', '', 'g') by0,
 {_LAST.format(k="run_id")} rn from report_card),
l as (select run_id, said, regexp_extract(lower(said), '([0-9]{{14}}-[^/]+)', 1) up, regexp_extract(lower(by0), '([0-9]{{14}}-[^/]+)', 1) by1 from r where rn = 1),
o as (select by1 run_id, min(run_id) older from l where by1 <> '' group by by1),
p as (select l.run_id, case when coalesce(said, '') <> '' then up else older end parent from l left join o using (run_id)),
n as (select p.run_id, q.run_id parent from p left join p q on q.run_id = p.parent),
t as (select run_id, run_id root, 0 depth, run_id path from n where parent is null
 union all select n.run_id, t.root, t.depth + 1, t.path || '>' || n.run_id from n join t on n.parent = t.run_id),
a as (select unnest(string_split(path, '>')) run_id from t),
d as (select run_id, count(*) - 1 descendants from a group by run_id)"""

SQL = {
    "p2_found": f"""
with r as (select *, coalesce(slug, substr(run_id, 16)) sl, substr(run_id, 1, 14) ts, {_LAST.format(k="run_id")} rn from report_card),
m as (select sl, ts, [{_PRINT}]::varchar f from r where rn = 1),
c as (select sl, ts, f, lag(f) over (partition by sl order by ts) p from m),
v as (select sl, ts from c where p is null or p <> f)
select sl slug, ts valid_from, coalesce(lead(ts) over (partition by sl order by ts), '') valid_to from v""",
    "p2_ledger": f"""
with c as (select coalesce(slug, substr(run_id, 16)) sl, substr(run_id, 1, 14) m, coalesce(ingested_at, timestamp '0001-01-01') rec, [{_PRINT}] f from report_card),
b as (select sl, m, min(rec) born from c group by all),
t as (select distinct sl, m, rec as seen, true own from c union select a.sl, a.m, l.born, false from b a join b l on l.sl = a.sl and l.m > a.m and l.born >= a.born),
u as (select sl, m, seen, bool_or(own) own from t group by all),
x as (select u.*, (select max_by(f, rec) from c where c.sl = u.sl and c.m = u.m and c.rec <= u.seen) f, (select min(l.m) from b l where l.sl = u.sl and l.m > u.m and l.born <= u.seen) until from u),
y as (select *, lag(until) over w prior, row_number() over w k from x window w as (partition by sl, m order by seen)),
z as (select * from y where own or k = 1 or until is distinct from prior)
select sl slug, {", ".join(f"f[{i + 1}] {m}" for i, m in enumerate(METRICS))}, m valid_from, until valid_to, seen recorded_from, lead(seen) over (partition by sl, m order by seen) recorded_to from z""",
    "p3_found": _P3 + """
select n.run_id, coalesce(t.root, '') root_run_id, coalesce(t.depth, -1)::bigint depth, coalesce(d.descendants, -1)::bigint descendants, coalesce(t.path, '') run_path
from n left join t using (run_id) left join d using (run_id)""",
    "p3_nested_sets": _P3 + """, pre as (select run_id, row_number() over (partition by root order by string_split(path, '>')) - 1 lo from t)
select n.run_id, n.parent, t.root, lo, lo + descendants + 1 hi, t.run_id is null as cyclic from n left join t using (run_id) left join d using (run_id) left join pre using (run_id)""",
    "p5_found": _P5 + " select * from gone",
    "p5_orphans_by_month": _P5 + " select ref_field, run_month, count(*) dead_refs, count(distinct owner_key) owners from gone group by all",
}
