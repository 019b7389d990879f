"""Queries that once did less than the whole job, against brute force."""

import json
import re
from collections import defaultdict

from pyspark.sql import functions as F

from foliospark.plans import catalog
from foliospark.sources import feeds
from foliospark.tables import read


def test_failed_messages_have_all_failures(spark, sf, tmp_path):
    want = defaultdict(list)
    for r in read(spark, sf, "events").filter("event_type = 'error'").collect():
        want[r.user_id].append(r.event_id)
    assert max(map(len, want.values())) > 5
    got = catalog.failed_messages(spark, sf).collect()
    assert {r.user_id: (r.part, r.failures, r.message) for r in got} == {u: (0, len(e), "; ".join(f"error:{i}" for i in sorted(e))) for u, e in want.items()}
    spark.range(2500).selectExpr("id as event_id", "1 as user_id", "'error' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    hot = sorted((r.part, r.failures, r.message.count("error:")) for r in catalog.failed_messages(spark, str(tmp_path)).collect())
    assert hot == [(0, 2500, 1000), (1, 2500, 1000), (2, 2500, 500)]


def test_feed_has_every_current_card_in_both_locales(spark, sf, tmp_path):
    more = read(spark, sf, "report_card").crossJoin(spark.range(4)).withColumn("run_id", F.concat_ws("-", "run_id", "id")).drop("id")
    more.write.parquet(str(tmp_path / "report_card.parquet"))
    sf = str(tmp_path)
    cards = sorted(catalog.current(spark, sf, "headline", "run_date", "company").collect(), key=lambda r: r.run_id, reverse=True)
    zh = {c.run_id: ("译文" + c.run_id if i % 3 else "  ") for i, c in enumerate(cards) if i % 2}
    spark.createDataFrame([(i, r, t, "zh-CN", "card-headline") for i, (r, t) in enumerate(zh.items())], "doc_id long, run_id string, text string, lang string, artifact string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.feed_items(spark, sf).collect()
    assert len(cards) > 20 and len(got) == 2 * len(cards)
    for second in (False, True):
        mine = [r for r in got if r.link.startswith("/zh/") == second]
        said = lambda c: zh[c.run_id] if second and zh.get(c.run_id, " ").strip() else c.headline
        assert [(r.title, r.description, r.pub_date) for r in mine] == [(c.company.name, said(c), c.run_date) for c in cards]
        assert all(c.run_id[15:] in r.link for r, c in zip(mine, cards))


def test_rss_writes_the_rest_to_further_parts(spark, tmp_path):
    items = spark.range(7).selectExpr("concat('t', id) as title", "'d' as description", "'2024-01-01' as pub_date", "'/a/' as link").orderBy("title")
    (tmp_path / "rss-4.xml").write_text("of an earlier feed")
    feeds.write_rss(items, str(tmp_path / "rss.xml"), "T", "https://e.org/", 3)
    assert [re.findall("<title>(t.)", (tmp_path / f).read_text()) for f in ("rss.xml", "rss-2.xml", "rss-3.xml")] == [["t0", "t1", "t2"], ["t3", "t4", "t5"], ["t6"]]
    assert len(list(tmp_path.iterdir())) == 3


def test_plain_text_covers_the_unwrapped_payload(spark, tmp_path):
    report = {"company": {"name": "A"}, "subtitle": "s", "chapters": [{"title": "T", "sections": [{"blocks": [{"type": "list", "items": ["x", True]}]}]}], "tables": []}
    wrapped = [json.dumps(report), json.dumps(json.dumps(report)), json.dumps({"report": report}), json.dumps([report]), json.dumps([None, {"report": json.dumps(report)}])]
    rows = [(i, p, 1) for i, p in enumerate([*wrapped, None, "no json", "[1, 2]", "[" * 100_000])]
    spark.createDataFrame(rows, "load_id bigint, payload string, ingested_at int").write.parquet(str(tmp_path / "full_report.parquet"))
    got = defaultdict(dict)
    for r in catalog.plain_text(spark, str(tmp_path)).collect():
        got[r.load_id][r.path] = r.text
    assert got[0]["$"] == "company: A, subtitle: s, chapters: T, tables" and got[0]["$.chapters[0].sections[0].blocks[0].items"] == "x, Yes"
    assert got[0]["$.chapters[0].sections"] == "blocks: type: list, items: x, Yes" and len(got[0]) == 16
    assert all(got[i] == got[0] for i in range(1, 5))
    assert [got[i] for i in (5, 6, 7)] == [{"$": ""}, {"$": "no json"}, {"$": "1, 2", "$[0]": "1", "$[1]": "2"}] and set(got[8]) == {"$"}


def test_metric_rows_have_growth_and_nrr(spark, tmp_path):
    kept = "valuation_usd_m double, revenue_run_rate_usd_m double, arr_usd_m double, revenue_growth_yoy_pct double, nrr_pct double"
    rows = [("a", (1500.0, 2.0, None, 1234.5678, 110.0), (None,), 1), ("b", (None, None, 3.0, float("nan"), None), (None,), 1)]
    spark.createDataFrame(rows, f"run_id string, key_metrics struct<{kept.replace(' double', ': double')}>, revision struct<status: string>, ingested_at int").write.parquet(str(tmp_path / "report_card.parquet"))
    got = [tuple(r) for r in catalog.metric_rows(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a", "Growth", "1,234.568%"), ("a", "NRR", "110%"), ("a", "Revenue", "$2M"), ("a", "Valuation", "$1.5B"), ("b", "ARR", "$3M")]
