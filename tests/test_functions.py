from pyspark.sql import functions as F

from foliospark.functions import classify, coerce, text


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_claim_references(spark):
    assert one(spark, text.strip_trailing_refs, "x [CO001] [CM002].", "x [CO001]\n", "x", None) == ["x.", "x [CO001]", "x", None]
    (p,) = one(spark, text.ref_parts, "a [CO001] b [CM045].")
    assert [tuple(x) for x in p] == [("text", "a "), ("ref", "CO001"), ("text", " b "), ("ref", "CM045"), ("text", ".")]
    assert [tuple(x) for x in one(spark, text.ref_parts, None)[0]] == [("text", "")] and one(spark, text.has_refs, "[CO01]", "[CO001]", None) == [False, True, False]


def test_labels_and_slugs(spark):
    assert one(spark, text.tag_slug, "Energy & climate", "--", "é") == ["energy-climate", "tag", "tag"]
    assert one(spark, text.display_label, "research-more", "strong-buy", "camelCase", "Free text", " high ", "", None) == ["Research more", "Strong Buy", "Camel Case", "Free text", "High", "", ""]
    assert one(spark, lambda x: text.display_label(x, True), "buy", "strong-buy") == ["买入", "strong-buy"] and one(spark, text.display_cell, " TBD ", "x", None) == ["待定", "x", None]
    assert one(spark, text.title_case, "ai saas for it") == ["AI SaaS For IT"] and one(spark, text.callout_class, "Risk!", None) == ["callout-risk", "callout-note"]


def test_numbers(spark):
    money = lambda x: text.money_m(x.cast("double"))
    assert one(spark, money, "999.95", "1000", "0.25", "-2500", "NaN", None) == ["$1,000M", "$1B", "$0.3M", "$-2.5B", None, None]
    assert one(spark, lambda x: text.metric(x.cast("double"), "%"), "1234.5678", "7") == ["1,234.568%", "7%"]
    assert one(spark, lambda x: text.to_fixed_1(x.cast("double")), "6.35", "6.25", "6.45", None) == ["6.3", "6.3", "6.5", None]


def test_markup_and_paths(spark):
    assert one(spark, lambda x: text.highlight(x, "a.b"), "A.b & acb") == ["<mark>A.b</mark> &amp; acb"] and one(spark, lambda x: text.highlight(x, " "), "<") == ["&lt;"]
    path = lambda x: text.locale_path(F.lit("/"), F.lit("zh"), x)
    assert one(spark, path, "/a//", "") == ["/zh/a/", "/zh/"] and one(spark, lambda x: text.locale_path(x, F.lit("en")), "/", "") == ["/", "/"]
    assert one(spark, lambda x: text.locale_file(x, F.lit("zh"), "rss.xml"), "/b") == ["/b/zh/rss.xml"] and one(spark, text.strip_tags, "<p> </p>") == [""]
    assert one(spark, text.host, "https://u@WWW.a.org:8/x", "nothing", None) == ["a.org", None, None] and one(spark, text.iso_date, " 3 Jun 2024", "2024-05", "soon") == ["2024-06-03", "2024-05", None]
    assert one(spark, lambda x: text.fill(x, n=F.lit(3)), "{n} of {m}") == ["3 of {m}"]


def test_plain_text(spark):
    assert text.plain({"label": {"value": 3.0}}) == "3" and text.plain([True, None, "a", {"x": 1, "y": " "}]) == "Yes, a, x: 1, y" and text.plain({"label": " ", "note": "n"}) == "n"
    assert one(spark, text.plain_text, '{"name": "a"}', "not json", None) == ["a", "not json", ""]


def test_classification(spark):
    assert one(spark, classify.buckets, "AI / Search & Data", "éai", "main", None, "") == [["AI", "Search"], ["AI"], ["Other"], ["Other"], ["Other"]]
    assert one(spark, classify.focus_tags, "AI / Search &  Data  labs / ai", None) == [["AI", "Search", "Data Labs"], ["Other"]]


def test_coercion(spark):
    docs = ['{"a": " x ", "n": 5, "l": ["p", 1, null, "q"]}', '{"a": "  ", "n": "5", "l": "p"}', '{"a": 5, "n": null}', "null", None]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(F.parse_json("d").alias("v"))
    got = [tuple(r) for r in df.select(coerce.string_or(coerce.get(F.col("v"), "$.a"), "fb"), coerce.number_or_null(coerce.get(F.col("v"), "$.n")), coerce.string_list(coerce.get(F.col("v"), "$.l"))).collect()]
    assert got == [(" x ", 5.0, ["p", "q"]), ("fb", None, []), ("fb", None, []), ("fb", None, []), ("fb", None, [])]


def test_cards_of_defaults(spark):
    df = spark.createDataFrame([("20260101000000-a", '{"summary": {"recommendation": "", "overallScore": "7"}, "revision": {"status": "odd"}, "junk": 1}'), ("no-stamp", None)], "run_id string, t string")
    a, b = coerce.report_cards(df.select("run_id", F.parse_json("t").alias("doc"))).collect()
    assert (a.recommendation, a.overall_score, a.revision.status, a.headline, a.run_timestamp) == ("", 0.0, "current", "Unknown company diligence report", "20260101000000")
    assert (b.recommendation, b.run_timestamp, b.slug, b.folder_slug[:9]) == ("research-more", "0" * 14, "no-stamp", "no-stamp-") and b.source_stats.averageSourceAgeDays is None
