"""Overlays, lookups, cached checks, label formats and card rules on hand-made rows, with the edges that the tables lack."""

from pyspark.sql import functions as F

from foliospark.functions import coerce, text
from foliospark.operators import links
from foliospark.plans import catalog, site
from foliospark.tables import last_delivery, read


def test_overlay_takes_what_says_something(spark):
    base = spark.createDataFrame([("a", "t", ["x"], None), ("b", "t", ["x"], "s"), ("c", None, None, None)], "k string, title string, list array<string>, sector string")
    over = spark.createDataFrame([("a", "　 ", [], "o", 1), ("b", "zh", ["y", None], None, 1), ("d", "no base", ["z"], "o", 1)], "k string, t string, l array<string>, s string, title int")
    got = {r.k: (r.title, r.list, r.sector) for r in links.overlaid(base, over, "k", {"title": "t", "list": "l", "sector": "s"}).collect()}
    assert got == {"a": ("t", ["x"], "o"), "b": ("zh", ["y", None], "s"), "c": (None, None, None)}
    assert links.overlaid(base, over.limit(0), "k", {"title": "t"}).count() == 3 and links.overlaid(base.limit(0), over, "k", {"title": "t"}).count() == 0


def test_paths_meet_their_entries(spark):
    paths = spark.createDataFrame([("/zh/one/",), ("/one",), ("/two/",), ("/",), (None,)], "path string")
    entries = spark.createDataFrame([("one", 1), ("three", 3), (None, 4)], "folder string, path_folder int")
    assert sorted((r.path, r.path_folder) for r in links.entries_of_paths(paths, "path", entries, "folder").collect()) == [("/one", 1), ("/zh/one/", 1)]
    assert links.lookup(entries, "folder", "one").count() == 1 and links.lookup(entries, "folder", "none").count() == 0


def test_cached_checks(spark):
    seen = spark.createDataFrame([("new", "1"), ("same", "1"), ("changed", "2"), ("old rules", "1"), ("blank", None)], "k string, digest string")
    cache = spark.createDataFrame([("same", "1", "v2"), ("changed", "1", "v2"), ("old rules", "1", "v1"), ("blank", None, "v2"), ("gone", "1", "v2")], "k string, digest string, v string")
    got = {r.k: r.action for r in links.check_actions(seen, cache, "k", "digest", "v", "v2").collect()}
    assert got == {"new": "new", "same": "skip", "changed": "changed", "old rules": "version", "blank": "skip"}


def test_formats_and_patterns(spark):
    df = spark.createDataFrame([("2024-01", "a/b.c", " G-1x ", 1234567.0), ("2024-13", "a/b/c", "G_1", 0.0), (None, None, None, None), ("soon", "a b/c", "g-", 12.5)], "m string, repo string, tag string, n double")
    got = [tuple(r) for r in df.select(text.month_label(F.col("m")), text.month_label(F.col("m"), True), coerce.is_repository(F.col("repo")), coerce.is_measurement_id(F.col("tag")), text.grouped(F.col("n"), 0)).collect()]
    assert got == [("January 2024", "2024年1月", True, True, "1,234,567"), (None, None, False, False, "0"), (None, None, False, False, None), (None, None, False, False, "13")]


def test_ties_are_broken_alike_whatever_columns_are_read(spark):
    rows = [("a", 1, "current", "x", 1), ("a", 1, "superseded", "y", 2), ("b", 2, None, "x", 3), ("b", 2, "current", "w", 4), ("c", None, "current", "z", 5)]
    df = spark.createDataFrame(rows, "k string, ingested_at int, status string, u string, v int")
    for columns in (["status"], ["status", "u"], ["v", "status"]):
        got = {r.k: r.status for r in last_delivery(df.select("k", "ingested_at", *columns), ["k"], ties=[F.col("status")]).collect()}
        assert got == {"a": "superseded", "b": "current", "c": "current"}


def test_every_rule_of_a_card_can_be_broken(spark, sf, tmp_path):
    good = read(spark, sf, "report_card").filter("schema_version = 'report-v2' and revision.status = 'current' and slug is not null").limit(1)
    bare = good.select(*[F.lit(None).cast(t).alias(c) if c not in ("run_id", "ingested_at") else F.lit("x").alias(c) if c == "run_id" else F.col(c) for c, t in good.dtypes])
    good.unionByName(bare).write.parquet(str(tmp_path / "report_card.parquet"))
    got = {}
    for r in site.schema_violations(spark, str(tmp_path)).collect():
        got.setdefault(r.run_id, set()).add(r.rule)
    assert set(got) == {"x"} and got["x"] == set(site._rules())


def test_runs_that_may_be_pruned(spark, tmp_path):
    run = lambda day, name: f"202401{day:02}000000-{name}"
    rows = [
        (run(1, "a"), "superseded", None, run(2, "a")), (run(2, "a"), "current", run(1, "a"), None),  # goes
        (run(1, "b"), "superseded", None, run(9, "b")),  # replaced by nothing
        (run(1, "c"), "superseded", None, run(2, "a")),  # by another company's
        (run(1, "d"), "superseded", None, run(2, "d")), (run(2, "d"), "current", None, None),  # that doesn't refresh it
        (run(1, "e"), "superseded", None, run(2, "e")), (run(2, "e"), "superseded", run(1, "e"), run(3, "e")), (run(3, "e"), "current", run(2, "e"), None),
        (run(5, "f"), "superseded", None, run(4, "f")), (run(4, "f"), "current", run(5, "f"), None),  # by an earlier one
        (run(1, "g"), "superseded", None, " "),
    ]
    df = spark.createDataFrame(rows, "run_id string, status string, refresh_of_run_id string, superseded_by_run_id string")
    df.select("run_id", F.struct("status", "refresh_of_run_id", "superseded_by_run_id").alias("revision"), F.lit(1).alias("ingested_at")).write.parquet(str(tmp_path / "report_card.parquet"))
    got = {r.run_id[15:] + r.run_id[7]: r.verdict for r in site.prunable_runs(spark, str(tmp_path)).collect()}
    assert got == {"a1": "prune", "b1": "missing", "c1": "unrelated", "d1": "inconsistent", "e1": "chain", "e2": "prune", "f5": "inconsistent"}


def test_queries_on_empty_tables(spark, sf, tmp_path):
    for t in ("report_card", "documents", "claim", "report_block", "evidence_source", "events"):
        read(spark, sf, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("schema_violations", "chapter_minimums", "missing_source_types", "validation_cache", "translation_sources", "prunable_runs", "revision_neighbours", "unresolved_edges", "overlay_fields", "page_entries", "locale_formats", "run_list"):
        assert site.QUERIES[name](spark, str(tmp_path)).count() == 0, name
    assert catalog.failed_messages(spark, str(tmp_path)).count() == catalog.feed_items(spark, str(tmp_path)).count() == 0
