"""Queries of the rules, pages and links around the report tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import coerce, text
from foliospark.operators import links, ranking
from foliospark.operators.references import clean_id
from foliospark.plans import catalog
from foliospark.plans.catalog import _BLOCKS, _CARDS, _CLAIMS, _CLEAN, _FOLDER, _SOURCES, _ZHDOC, blocks, cards, current, live
from foliospark.plans.problems import clean_run
from foliospark.tables import last_delivery, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
_SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# P10: rules of a card, true where the card keeps them.
def _rules() -> dict[str, Column]:
    given = lambda c: F.col(c).isNotNull()
    texts = lambda c: F.coalesce(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    stats = ("sources_retained", "claims_reviewed", "domain_count", "adverse_source_count", "open_question_count", "documented_gap_question_count", "blocking_question_count")
    return {
        "schema version": F.col("schema_version").eqNullSafe(F.lit("report-v2")), "artifact": F.col("artifact").eqNullSafe(F.lit("summary-card")),
        **{f"{c} missing": given(c) for c in ("run_timestamp", "folder_slug", "slug", "run_date", "headline", "recommendation", "confidence", "risk_rating", "valuation_stance")},
        "company name missing": F.col("company.name").isNotNull(), "status unknown": F.coalesce(F.col("revision.status").isin("current", "superseded"), F.lit(False)), "score is no number": number("overall_score"),
        **{f"{c} is no number": number(f"source_stats.{c}") for c in stats}, **{f"{c} is no list of texts": texts(c) for c in ("top_strengths", "top_risks", "unresolved_gaps")},
    }


@query("schema_violations", """with c as (select * from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last, revision.status desc nulls last) rn from report_card) where rn = 1),
v as (select run_id, unnest(list_filter([
 case when schema_version is distinct from 'report-v2' then 'schema version' end, case when artifact is distinct from 'summary-card' then 'artifact' end,
 case when run_timestamp is null then 'run_timestamp missing' end, case when folder_slug is null then 'folder_slug missing' end, case when slug is null then 'slug missing' end, case when run_date is null then 'run_date missing' end,
 case when headline is null then 'headline missing' end, case when recommendation is null then 'recommendation missing' end, case when confidence is null then 'confidence missing' end, case when risk_rating is null then 'risk_rating missing' end,
 case when valuation_stance is null then 'valuation_stance missing' end, case when company.name is null then 'company name missing' end,
 case when revision.status is null or revision.status not in ('current', 'superseded') then 'status unknown' end, case when overall_score is null or isnan(overall_score) then 'score is no number' end,
 case when source_stats.sources_retained is null or isnan(source_stats.sources_retained) then 'sources_retained is no number' end, case when source_stats.claims_reviewed is null or isnan(source_stats.claims_reviewed) then 'claims_reviewed is no number' end,
 case when source_stats.domain_count is null or isnan(source_stats.domain_count) then 'domain_count is no number' end, case when source_stats.adverse_source_count is null or isnan(source_stats.adverse_source_count) then 'adverse_source_count is no number' end,
 case when source_stats.open_question_count is null or isnan(source_stats.open_question_count) then 'open_question_count is no number' end,
 case when source_stats.documented_gap_question_count is null or isnan(source_stats.documented_gap_question_count) then 'documented_gap_question_count is no number' end,
 case when source_stats.blocking_question_count is null or isnan(source_stats.blocking_question_count) then 'blocking_question_count is no number' end,
 case when top_strengths is null or len(list_filter(top_strengths, lambda x: x is null)) > 0 then 'top_strengths is no list of texts' end, case when top_risks is null or len(list_filter(top_risks, lambda x: x is null)) > 0 then 'top_risks is no list of texts' end,
 case when unresolved_gaps is null or len(list_filter(unresolved_gaps, lambda x: x is null)) > 0 then 'unresolved_gaps is no list of texts' end], lambda x: x is not null)) as rule from c)
select run_id, rule from v""")
def schema_violations(s, d):
    """P10: each rule of the card's schema that a run's last delivery breaks."""
    c = last_delivery(read(s, d, "report_card"), ["run_id"], ties=[F.col("revision.status")])
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in _rules().items()]))
    return c.select("run_id", F.explode(broken).alias("rule"))


def chapter_claims(s, d) -> DataFrame:
    """(run_id, chapter_number, claim_id, claim_type, source_refs): the claims that a chapter's blocks refer to, each once."""
    refs = blocks(s, d, "chapter_number", "claim_refs").select("run_id", "chapter_number", F.explode("claim_refs").alias("claim_id")).distinct()
    return refs.join(live(s, d, "claim", "claim_key", "run_id", "claim_id", "claim_type", "source_refs"), ["run_id", "claim_id"])


_CHAPTERS = f"with {_BLOCKS}, {_CLAIMS}, r as (select distinct run_id, chapter_number, unnest(claim_refs) claim_id from blocks), k as (select r.run_id, chapter_number, r.claim_id, claim_type, source_refs from r join claims using (run_id, claim_id))"


@query("chapter_minimums", _CHAPTERS + """, b as (select run_id, chapter_number, count(distinct section_id) sections, count(distinct table_ref) tables, count(distinct figure_ref) figures from blocks group by all),
c as (select run_id, chapter_number, count(distinct claim_id) claims, count(distinct case when claim_type = 'open-question' then claim_id end) questions, count(distinct case when claim_type = 'conflicting' then claim_id end) gaps from k group by all),
o as (select run_id, chapter_number, count(distinct ref) sources from (select run_id, chapter_number, unnest(source_refs) ref from k) group by all),
m as (select run_id, chapter_number, unnest(['sections', 'tables', 'figures', 'sources', 'claims', 'questions', 'gaps']) measure, unnest([3, 4, 3, 10, 8, 1, 1]) least,
 unnest([sections, tables, figures, coalesce(sources, 0), coalesce(claims, 0), coalesce(questions, 0), coalesce(gaps, 0)]) n from b left join c using (run_id, chapter_number) left join o using (run_id, chapter_number))
select run_id, chapter_number, measure, n, least::bigint least from m where n < least""")
def chapter_minimums(s, d):
    """V4: each chapter's counts that are below their minimum, a table of seven."""
    least = s.createDataFrame([("sections", 3), ("tables", 4), ("figures", 3), ("sources", 10), ("claims", 8), ("questions", 1), ("gaps", 1)], "measure string, least long")
    of = lambda kind: F.countDistinct(F.when(F.col("claim_type") == kind, F.col("claim_id")))
    k = chapter_claims(s, d)
    b = blocks(s, d, "chapter_number", "section_id", "table_ref", "figure_ref").groupBy("run_id", "chapter_number").agg(F.countDistinct("section_id").alias("sections"), F.countDistinct("table_ref").alias("tables"), F.countDistinct("figure_ref").alias("figures"))
    c = k.groupBy("run_id", "chapter_number").agg(F.countDistinct("claim_id").alias("claims"), of("open-question").alias("questions"), of("conflicting").alias("gaps"))
    o = k.select("run_id", "chapter_number", F.explode("source_refs").alias("ref")).groupBy("run_id", "chapter_number").agg(F.countDistinct("ref").alias("sources"))
    n = b.join(c, ["run_id", "chapter_number"], "left").join(o, ["run_id", "chapter_number"], "left").fillna(0, ["sources", "claims", "questions", "gaps"])
    names = ["sections", "tables", "figures", "sources", "claims", "questions", "gaps"]
    return n.unpivot(["run_id", "chapter_number"], names, "measure", "n").join(F.broadcast(least), "measure").filter("n < least").select("run_id", "chapter_number", "measure", "n", "least")


@query("missing_source_types", _CHAPTERS + f""", {_SOURCES}, o as (select distinct run_id, chapter_number, unnest(source_refs) source_id from k), t as (select o.run_id, chapter_number, list(distinct source_type) have from o join sources using (run_id, source_id) group by all),
c as (select distinct run_id, chapter_number from blocks)
select run_id, chapter_number, unnest(list_filter(['filing', 'news', 'regulatory', 'official'], lambda x: have is null or not list_contains(have, x))) missing from c left join t using (run_id, chapter_number)""")
def missing_source_types(s, d):
    """V5: the required source types that no source of a chapter's claims has."""
    chapters = blocks(s, d, "chapter_number").select("run_id", "chapter_number").distinct()
    refs = chapter_claims(s, d).select("run_id", "chapter_number", F.explode("source_refs").alias("source_id")).distinct()
    have = refs.join(live(s, d, "evidence_source", "source_key", "run_id", "source_id", "source_type"), ["run_id", "source_id"]).groupBy("run_id", "chapter_number").agg(F.collect_set("source_type").alias("have"))
    wanted = F.array(*map(F.lit, ("filing", "news", "regulatory", "official")))
    lacking = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return chapters.join(have, ["run_id", "chapter_number"], "left").select("run_id", "chapter_number", F.explode(lacking).alias("missing"))


@query("validation_cache", """with a as (select run_id, sha1(headline) h, schema_version v, overall_score sc, ingested_at from report_card), o as (select run_id, arg_min({'h': h, 'v': v, 'sc': sc}, ingested_at) x from a group by 1), n as (select run_id, arg_max({'h': h}, ingested_at).h now from a group by 1)
select run_id, case when o.run_id is null then 'new' when x.h is distinct from now then 'changed' when x.v is distinct from 'report-v2' then 'version' else 'skip' end as action from n left join (select * from o where x.sc >= 4.0) o using (run_id)""")
def validation_cache(s, d):
    """V8: a check is skipped only where digest and rule version are those of a cached pass; the first deliveries that passed are the cache."""
    a = read(s, d, "report_card").select("run_id", F.sha1(F.col("headline").cast("binary")).alias("digest"), F.col("schema_version").alias("version"), "overall_score", "ingested_at")
    g = a.groupBy("run_id").agg(F.min_by(F.struct("digest", "version", "overall_score"), "ingested_at").alias("was"), F.max_by(F.struct("digest"), "ingested_at").alias("now"))
    cache = g.filter("was.overall_score >= 4.0").select("run_id", "was.digest", "was.version")
    return links.check_actions(g.select("run_id", "now.digest"), cache, "run_id", "digest", "version", "report-v2")


@query("translation_sources", f"with a as (select run_id, headline, ingested_at from report_card), {_ZHDOC}, g as (select run_id, sha1(arg_min(headline, ingested_at)) was, sha1(arg_max(headline, ingested_at)) now from a group by 1) select run_id, was as source_hash, case when was = now then 'current' else 'blocked' end state from g join z using (run_id)")
def translation_sources(s, d):
    """A translation keeps the digest of the text that it was made from; a changed source blocks it."""
    a = read(s, d, "report_card").groupBy("run_id").agg(F.min_by("headline", "ingested_at").alias("was"), F.max_by("headline", "ingested_at").alias("now"))
    h = a.select("run_id", *[F.sha1(F.col(c).cast("binary")).alias(c) for c in ("was", "now")])
    return h.join(catalog._overlay(s, d).select("run_id"), "run_id").select("run_id", F.col("was").alias("source_hash"), F.when(F.col("was") == F.col("now"), "current").otherwise("blocked").alias("state"))


@query("prunable_runs", _CARDS + ", c as (select run_id, " + _CLEAN.format(c="revision.superseded_by_run_id") + " t, " + _CLEAN.format(c="revision.refresh_of_run_id") + """ back, revision.status st from cards)
select a.run_id, a.t target, case when b.run_id is null then 'missing' when substr(a.run_id, 16) <> substr(a.t, 16) then 'unrelated' when substr(a.t, 1, 14) <= substr(a.run_id, 1, 14) or b.back is distinct from a.run_id then 'inconsistent' when b.st = 'superseded' then 'chain' else 'prune' end verdict
from c a left join c b on b.run_id = a.t where a.st = 'superseded' and a.t is not null""")
def prunable_runs(s, d):
    """V9: superseded runs, and whether what is said to replace them lets them go: it exists, is of the same company, later, and refreshes them; a replaced replacement is a chain."""
    c = cards(s, d, "revision").select("run_id", clean_run(F.col("revision.superseded_by_run_id")).alias("target"), clean_run(F.col("revision.refresh_of_run_id")).alias("back"), "revision.status")
    old = c.filter("status = 'superseded' and target is not null").select("run_id", "target")
    new = c.select(F.col("run_id").alias("target"), F.lit(True).alias("known"), F.col("back"), F.col("status").alias("then"))
    company, stamp = (lambda x: F.substring(x, 16, 10_000)), (lambda x: F.substring(x, 1, 14))
    verdict = F.when(F.col("known").isNull(), "missing").when(company("run_id") != company("target"), "unrelated").when((stamp("target") <= stamp("run_id")) | ~F.col("back").eqNullSafe(F.col("run_id")), "inconsistent").when(F.col("then") == "superseded", "chain")
    return old.join(new, "target", "left").select("run_id", "target", verdict.otherwise("prune").alias("verdict"))


@query("revision_neighbours", _CARDS + ", c as (select run_id, " + _CLEAN.format(c="revision.refresh_of_run_id") + " up from cards), k as (select up run_id, min(run_id) later from c where up is not null group by 1) select c.run_id, p.run_id previous, later as next from c left join cards p on p.run_id = c.up left join k on k.run_id = c.run_id")
def revision_neighbours(s, d):
    """The run before and after each in its line of revisions."""
    c = cards(s, d, "revision").select("run_id", clean_run(F.col("revision.refresh_of_run_id")).alias("up"))
    after = c.filter("up is not null").groupBy(F.col("up").alias("run_id")).agg(F.min("run_id").alias("next"))
    known = c.select(F.col("run_id").alias("up"), F.col("run_id").alias("previous"))
    return c.join(known, "up", "left").join(after, "run_id", "left").select("run_id", "previous", "next")


_IDTRIM = rf"^(?:{_SP}|[\[\](){{}}])+|(?:{_SP}|[\[\](){{}}])+$"


@query("unresolved_edges", f"with {_CLAIMS}, {_SOURCES}, e as (select claim_key, run_id, unnest(source_refs) r from claims), n as (select run_id || '/' || upper(source_id) node, count(*) c from sources group by 1), t as (select distinct claim_key, run_id || '/' || upper(regexp_replace(r, '{_IDTRIM}', '', 'g')) target from e where regexp_replace(r, '{_IDTRIM}', '', 'g') <> '') select claim_key, target, coalesce(c, 0)::bigint matches from t left join n on n.node = t.target where coalesce(c, 0) <> 1")
def unresolved_edges(s, d):
    """References of claims to sources of their run that meet none of them, or several."""
    key = lambda ref: F.concat_ws("/", "run_id", ref)
    e = live(s, d, "claim", "claim_key", "run_id", "source_refs").select("claim_key", "run_id", F.explode("source_refs").alias("raw")).withColumn("ref", clean_id(F.col("raw"))).filter("ref is not null").select("claim_key", key("ref").alias("target")).distinct()
    nodes = live(s, d, "evidence_source", "source_key", "run_id", "source_id").select(key(F.upper("source_id")).alias("node"))
    return links.unresolved_edges(e, nodes, "target", "node").select("claim_key", "target", "matches")


@query("ambiguous_labels", f"with {_SOURCES}, t as (select source_key, topics[1] target from sources where topics[1] is not null), n as (select title node, count(*) c from sources group by 1), p as (select source_key, title target from sources where title is not null) select source_key, target, coalesce(c, 0)::bigint matches from (select * from p union all select * from t) x left join n on n.node = x.target where coalesce(c, 0) <> 1")
def ambiguous_labels(s, d):
    """Ends that name a source by its title: several bear it, or (a topic in place of a title) none."""
    src = live(s, d, "evidence_source", "source_key", "title", "topics")
    ends = src.select("source_key", F.explode(F.array("title", F.try_element_at("topics", F.lit(1)))).alias("target")).filter("target is not null")
    return links.unresolved_edges(ends, src.select(F.col("title").alias("node")), "target", "node").select("source_key", "target", "matches")


@query("dangling_contradictions", f"with {_CLAIMS}, r as (select claim_key, run_id, unnest(contradicts_claim_refs) ref from (select * from claim where contradicts_claim_refs is not null)) select distinct claim_key, ref from r where ref is not null and not exists (select 1 from claims c where c.run_id = r.run_id and c.claim_id = r.ref and c.claim_type <> 'open-question')")
def dangling_contradictions(s, d):
    """V2 on contradictions: those ever delivered whose other claim is gone or is no more than an open question."""
    c = live(s, d, "claim", "claim_key", "run_id", "claim_id", "claim_type").filter("claim_type <> 'open-question'")
    r = read(s, d, "claim").select("claim_key", "run_id", F.explode("contradicts_claim_refs").alias("claim_id")).filter("claim_id is not null").distinct()
    return links.without(r, c, ["run_id", "claim_id"]).select("claim_key", F.col("claim_id").alias("ref")).distinct()


@query("overlay_fields", _CARDS + f", {_ZHDOC}, o as (select run_id, arg_min(" + "{'sector': company.sector, 'stage': company.stage, 'risks': top_risks}" + """, ingested_at) x from report_card group by 1)
select run_id, coalesce(case when trim(zh) <> '' then zh end, headline) headline, coalesce(case when trim(x.sector) <> '' then x.sector end, company.sector, 'Other') sector, coalesce(case when trim(x.stage) <> '' then x.stage end, company.stage) stage,
array_to_string(coalesce(case when len(x.risks) > 0 then x.risks end, top_risks), '|') risks from cur left join z using (run_id) left join o using (run_id)""")
def overlay_fields(s, d):
    """Headline, sector, stage and lists each from the overlay where it says something, then from the card; the sector at last is Other."""
    base = current(s, d, "headline", "company", "top_risks").select("run_id", "headline", F.col("company.sector").alias("sector"), F.col("company.stage").alias("stage"), F.col("top_risks").alias("risks"))
    first = read(s, d, "report_card").groupBy("run_id").agg(F.min_by(F.struct("company.sector", "company.stage", F.col("top_risks").alias("risks")), "ingested_at").alias("x")).select("run_id", "x.*")
    overlay = first.join(catalog._overlay(s, d), "run_id", "full_outer")
    shown = links.overlaid(base, overlay, "run_id", {"headline": "zh", "sector": "sector", "stage": "stage", "risks": "risks"})
    return shown.select("run_id", "headline", F.coalesce("sector", F.lit("Other")).alias("sector"), "stage", F.array_join("risks", "|").alias("risks"))


@query("page_entries", _CARDS + f", p as (select l || {_FOLDER} || '/' path from cards, (values ('/'), ('/zh/')) v(l)), e as (select {_FOLDER} folder, run_id, company.name title, headline description from cur) select path, run_id, title, description from p join e on e.folder = regexp_extract(path, '([^/]+)/$', 1)")
def page_entries(s, d):
    """Each page path with the current run that it shows; paths of superseded runs show none."""
    paths = catalog._foldered(cards(s, d).select("run_id")).select(F.explode(F.array(F.concat(F.lit("/"), "folder_slug", F.lit("/")), F.concat(F.lit("/zh/"), "folder_slug", F.lit("/")))).alias("path"))
    entries = catalog._foldered(current(s, d, "company", "headline")).select("folder_slug", "run_id", F.col("company.name").alias("title"), F.col("headline").alias("description"))
    return links.entries_of_paths(paths, "path", entries, "folder_slug").select("path", "run_id", "title", "description")


@query("report_lookup", _CARDS + " select run_id, headline from cards where run_id = (select max(run_id) from report_card)")
def report_lookup(s, d):
    """One run's card by its id, here the newest."""
    newest = read(s, d, "report_card").agg(F.max("run_id")).head()[0]
    return links.lookup(last_delivery(links.lookup(read(s, d, "report_card").select("run_id", "headline", "ingested_at", F.struct("revision.status").alias("revision")), "run_id", newest), ["run_id"], ties=[F.col("revision.status")]), "run_id", newest).select("run_id", "headline")


@query("locale_formats", catalog._MONTHS + " select month, strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y') en_month, substr(month, 1, 4) || '年' || substr(month, 6, 2)::int || '月' zh_month, format('{:,}', total::bigint) sources from m")
def locale_formats(s, d):
    """Months and numbers as either locale writes them."""
    m = catalog._months(s, d)
    return m.select("month", text.month_label(F.col("month")).alias("en_month"), text.month_label(F.col("month"), True).alias("zh_month"), text.grouped(F.col("total"), 0).alias("sources"))


@query("run_list", "select run_id, row_number() over (order by run_id desc) as place from (select distinct run_id from report_card) qualify place <= 50")
def run_list(s, d):
    """Run folders, last name first; the newest fifty are what a listing page shows."""
    return ranking.leaders(read(s, d, "report_card").select("run_id").distinct(), [F.desc("run_id")], 50).select("run_id", F.col("rank").alias("place"))


@query("config_patterns", r"select run_id, regexp_matches(slug || '/' || artifact, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') is true repo_ok, regexp_matches(trim(' g-' || upper(substr(slug, 1, 4)) || ' '), '^[Gg]-[A-Za-z0-9]+$') is true tag_ok, regexp_matches(company.website || '/' || slug, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') is true site_ok from report_card")
def config_patterns(s, d):
    """F8: settings that must look like owner/repo or a measurement id."""
    c = read(s, d, "report_card")
    return c.select("run_id", coerce.is_repository(F.concat("slug", F.lit("/"), "artifact")).alias("repo_ok"), coerce.is_measurement_id(F.concat(F.lit(" g-"), F.upper(F.substring("slug", 1, 4)), F.lit(" "))).alias("tag_ok"), coerce.is_repository(F.concat("company.website", F.lit("/"), "slug")).alias("site_ok"))


@query("norm_texts", f"select publisher, lower(regexp_replace(publisher, '^{_SP}+|{_SP}+$', '', 'g')) as norm from (select distinct publisher from evidence_source)")
def norm_texts(s, d):
    """Lower case without any Unicode white space around it."""
    return read(s, d, "evidence_source").select("publisher").distinct().select("publisher", text.norm(F.col("publisher")).alias("norm"))


@query("skipped_reads", """with o as (select run_id, arg_min(sha1(headline), ingested_at) was from report_card group by 1), n as (select run_id, sha1(headline) now, overall_score >= 3 ok from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last) rn from report_card) where rn = 1)
select run_id, case when was = now then 'reused' when ok then 'loaded' else 'skipped' end as action, true as was_stored from o join n using (run_id)""")
def skipped_reads(s, d):
    """First deliveries as the store; a changed card with a low score stands for one that can't be read and keeps its stored row."""
    a = read(s, d, "report_card").select("run_id", F.sha1(F.col("headline").cast("binary")).alias("digest"), (F.col("overall_score") >= 3).alias("ok"), "ingested_at")
    stored = a.groupBy("run_id").agg(F.min_by("digest", "ingested_at").alias("digest"))
    return links.manifest_actions(stored, last_delivery(a, ["run_id"]).drop("ingested_at"), "run_id", parsed="ok")
