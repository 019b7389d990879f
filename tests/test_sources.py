import json
import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators import links, ranking
from foliospark.sources import feeds, folders, store
from foliospark.streaming import schedule


@pytest.fixture
def root(tmp_path):
    files = {
        "20260101000000-alpha": "company: {name: Alpha}\nrunDate: 2026-01-01\nat: 12:30\nyes: yes\nn: 1e3\nnone: ~\n", "20260102000000-beta": "a: [1\n", "_hidden": "a: 1\n", ".hidden": "a: 1\n",
        "no-timestamp": "a: 2026-01-02T23:00:00+00:00\n", "20260104000000-list": "- 1\n", "20260105000000-twice": "a: 1\na: 2\n",
    }
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary-card.yaml").write_text(text)
    (tmp_path / "20260103000000-gamma").mkdir()
    return tmp_path


def test_reading_folders(spark, root):
    pytest.importorskip("yaml")
    got = {r.run_id: r for r in folders.parsed(folders.files(spark, str(root), "summary-card.yaml")).select("run_id", F.to_json("doc").alias("j"), "parse_error").collect()}
    assert set(got) == {"20260101000000-alpha", "20260102000000-beta", "no-timestamp", "20260104000000-list", "20260105000000-twice"}
    assert json.loads(got["20260101000000-alpha"].j) == {"company": {"name": "Alpha"}, "runDate": "2026-01-01", "at": "12:30", "yes": "yes", "n": 1000.0, "none": None}
    assert json.loads(got["no-timestamp"].j) == {"a": "2026-01-02"} and got["20260104000000-list"].parse_error == "root is no mapping" and "duplicated" in got["20260105000000-twice"].parse_error
    assert folders.files(spark, str(root / "nowhere"), "summary-card.yaml").count() == 0


def test_refresh_keeps_stale_rows_and_prunes(spark, root):
    pytest.importorskip("yaml")
    digest = {r.run_id: r.digest for r in folders.files(spark, str(root), "summary-card.yaml").collect()}
    stored = spark.createDataFrame([("20260101000000-alpha", digest["20260101000000-alpha"], '{"old":1}'), ("20260102000000-beta", "0", '{"kept":1}'), ("20260103000000-gamma", "0", "{}")], "run_id string, digest string, text string")
    rows, actions = folders.refresh(spark, str(root), "summary-card.yaml", stored)
    assert {r.run_id: r.action for r in actions.collect()} == {"20260101000000-alpha": "reused", "20260102000000-beta": "skipped", "20260103000000-gamma": "pruned", "no-timestamp": "loaded", "20260104000000-list": "skipped", "20260105000000-twice": "skipped"}
    assert {r.run_id: r.text for r in rows.collect()} == {"20260101000000-alpha": '{"old":1}', "20260102000000-beta": '{"kept":1}', "no-timestamp": '{"a":"2026-01-02"}'}


def test_feeds_and_files(spark, tmp_path):
    pairs = spark.createDataFrame([("20240101000000-a", "20240201000000-b")], "from_run string, to_run string")
    routes = {r.route: r.target for r in feeds.redirect_routes(pairs, "/s").collect()}
    assert len(routes) == 2 and all(t.startswith("/s/") for t in routes.values()) and any(r.startswith("/zh/a-") for r in routes)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text('{"from": "a",\n "to": "b"}')
    assert [tuple(r) for r in folders.redirects(spark, str(tmp_path / "r")).collect()] == [("a", "b")]
    (tmp_path / "i.json").write_text('[{"href": "/a/", "title": "A", "rating": 1.5}]')
    (tmp_path / "o.json").write_text('{"href": "/a/"}')
    assert folders.search_index(spark, str(tmp_path / "i.json")).count() == 1 and folders.search_index(spark, str(tmp_path / "o.json")).count() == 0
    items = spark.createDataFrame([("A & B", "d", "2024-01-01", "/a/")], "title string, description string, pub_date string, link string")
    feeds.write_rss(items, str(tmp_path / "rss.xml"), "T", "https://e.org/", 5)
    assert "<title>A &amp; B</title>" in (tmp_path / "rss.xml").read_text()


def test_schedule_of_a_day(spark):
    df = spark.sql("select timestamp'2026-01-01 00:00:00' a, timestamp'2026-01-01 23:59:00' b")
    assert {r.job: r["count"] for r in schedule.due_between(df, "a", "b").groupBy("job").count().collect()} == {"research": 4, "translate": 12, "refresh": 1}
    due = lambda t: spark.sql(f"select timestamp'{t}' t").select(schedule.due(F.col("t"))).head()[0]
    assert due("2026-01-01 06:00:00") == ["research", "translate"] and due("2026-01-01 01:00:00") == due("2026-01-01 06:01:00") == []


STREAM = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("at", T.LongType())])


def feed(spark, tmp_path, name, rows, check="check"):
    (tmp_path / "src").mkdir(exist_ok=True)
    (tmp_path / "src" / name).write_text("\n".join(json.dumps(dict(zip(("k", "v", "at"), r))) for r in rows))
    q = schedule.refresh_stream(spark, str(tmp_path / "src"), STREAM, "k", "at", str(tmp_path / "store"), str(tmp_path / check))
    q.awaitTermination(120)
    assert q.exception() is None
    return {(r.k, r.v) for r in schedule.current_store(spark, str(tmp_path / "store")).collect()}


def test_refresh_stream(spark, tmp_path):
    assert feed(spark, tmp_path, "1.json", [("a", 1, 1), ("b", 1, 1)]) == {("a", 1), ("b", 1)}
    assert feed(spark, tmp_path, "2.json", [("a", 2, 2), ("b", 0, 0)]) == {("a", 2), ("b", 1)}
    assert schedule.current_store(spark, str(tmp_path / "none")) is None


def test_a_store_loses_nothing(spark, tmp_path):
    feed(spark, tmp_path, "1.json", [(f"k{i}", 1, 1) for i in range(200)])
    got = feed(spark, tmp_path, "2.json", [("k1", 2, 2)])
    manifests = sorted(f for f in (tmp_path / "store" / "manifests").iterdir() if f.suffix == ".json")
    data = {f.name for f in (tmp_path / "store" / "data").iterdir()}
    assert len(manifests) == 2 and len(list((tmp_path / "store" / "data" / max(data)).glob("bucket=*"))) == 1
    manifests[-1].write_text("{half a manif")  # torn
    assert {(r.k, r.v) for r in schedule.current_store(spark, str(tmp_path / "store")).collect()} == {(f"k{i}", 1) for i in range(200)}
    manifests[-1].unlink()  # gone
    assert feed(spark, tmp_path, "3.json", [("new", 1, 1)]) == {(f"k{i}", 1) for i in range(200)} | {("new", 1)}
    # a lost checkpoint: all files come again, in a first batch
    assert feed(spark, tmp_path, "3.json", [("new", 1, 1)], "other") == got | {("new", 1)}
    for f in (tmp_path / "store" / "manifests").iterdir():
        f.write_text("torn")
    with pytest.raises(OSError):
        schedule.current_store(spark, str(tmp_path / "store"))


def test_refresh_store(spark, root, tmp_path_factory):
    pytest.importorskip("yaml")
    target = str(tmp_path_factory.mktemp("out") / "store")
    act = lambda: {r.run_id: r.action for r in folders.refresh_store(spark, str(root), "summary-card.yaml", target).collect()}
    held = lambda: {r.run_id: r.text for r in store.current(spark, target).collect()}
    first = act()
    assert first["20260101000000-alpha"] == "loaded" and first["20260102000000-beta"] == "skipped" and set(held()) == {"20260101000000-alpha", "no-timestamp"}
    assert act() == {**first, "20260101000000-alpha": "reused", "no-timestamp": "reused"}
    (root / "20260101000000-alpha" / "summary-card.yaml").write_text("a: [2\n")
    (root / "20260102000000-beta" / "summary-card.yaml").write_text("a: 3\n")
    (root / "no-timestamp" / "summary-card.yaml").unlink()
    before = held()
    third = act()
    assert (third["20260101000000-alpha"], third["20260102000000-beta"], third["no-timestamp"]) == ("skipped", "loaded", "pruned")
    assert held() == {"20260101000000-alpha": before["20260101000000-alpha"], "20260102000000-beta": '{"a":3}'}
    assert act()["20260101000000-alpha"] == "skipped" and [r.run_id for r in folders.listing(spark, str(root), "summary-card.yaml").collect()][0] == "20260105000000-twice"


def test_search_index_and_sitemap_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"/{i}/", f"T “{i}”", "", 1.5, None, "x") for i in range(7)], "href string, title string, sector string, rating double, date string, search_text string")
    for name, files in (("one", 1), ("many", 3), ("none", 2)):
        feeds.write_search_index(docs.limit(0) if name == "none" else docs, str(tmp_path / name), files)
        got = sorted(tuple(r) for r in folders.search_index(spark, str(tmp_path / name)).collect())
        assert got == ([] if name == "none" else sorted(tuple(r) for r in docs.collect()))
    (one,) = (tmp_path / "one").glob("part-*")
    assert [d["searchText"] for d in json.loads(one.read_text())] == ["x"] * 7
    feeds.write_sitemap(spark.range(25).selectExpr("concat('<url><loc>', id, '</loc></url>') as xml"), str(tmp_path / "map"), 10)
    parts = [ElementTree.parse(f).getroot() for f in (tmp_path / "map").glob("part-*")]
    assert sum(len(p) for p in parts) == 25 and all(len(p) <= 10 for p in parts) and len(ElementTree.parse(tmp_path / "map" / "sitemap-index.xml").getroot()) == len(parts)
    assert feeds.rfc_822("2024-01-05") == "Fri, 05 Jan 2024 00:00:00 GMT" and feeds.rfc_822("soon") is None


def test_a_scan_reads_what_is_used(spark, sf):
    from foliospark.plans import catalog

    plan = catalog.current_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    (schema,) = set(re.findall(r"ReadSchema: (struct<.*?>)(?:\n|$)", plan))
    assert schema == "struct<run_id:string,revision:struct<status:string>,ingested_at:timestamp_ntz>"


def test_spread_looks_at_nodes_not_names(spark, tmp_path):
    from foliospark.tables import spread

    spark.range(3).selectExpr("id as Sort_key", "id as `Join`").coalesce(1).write.parquet(str(tmp_path / "Window.parquet"))
    df = spark.read.parquet(str(tmp_path / "Window.parquet"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df.distinct()) is not None


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from foliospark.tables import scratch_dir

    session = lambda master, conf: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        scratch_dir(session("spark://host:7077", None))
    assert scratch_dir(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x" and scratch_dir(session("local[4]", None))


def test_manifest_of_nothing_prunes_all(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, digest string")
    assert [r.action for r in links.manifest_actions(stored, stored.limit(0), "k").collect()] == ["pruned"] * 2 and links.manifest_actions(stored.limit(0), stored, "k").filter("action = 'loaded'").count() == 2


def test_ranking_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", "superseded"), ("c", "current")], "k string, s string")
    assert ranking.current(df, F.col("s")).count() == 2 and ranking.contains(df, F.col("k"), "  ").count() == 0 and ranking.contains(df, F.col("k"), "%").count() == 0
    few = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert ranking.rest(few, "k", [F.desc("n")]).count() == 2 and [r.rank_label for r in ranking.leaders(few, [F.desc("n")]).orderBy("rank").collect()] == ["#1", "#2"]
    assert few.select(ranking.padded_rank(F.lit(7)), ranking.padded_rank(F.lit(123)), ranking.share_of_max(F.lit(1), F.lit(0))).head()[:3] == ("07", "123", 100)
