import json

from foliospark.operators.flatten import REPORT, child_rows, flatten_json, shape_report


def nodes(spark, *payloads, **more):
    df = spark.createDataFrame([(f"r{i}", p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads)], "run_id string, payload string, kind string")
    return {(r.run_id, r.node_path, r.parent_path, r.kind) for r in flatten_json(df, ["run_id"], "payload", shape_report, REPORT).collect()}


CHAPTER = {"number": 1, "title": "t", "sections": [{"title": "s", "blocks": [{"type": "list", "items": ["a", None, {"label": "b"}]}, None, "text"]}]}
PATHS = {"chapters[0]", "chapters[0].sections[0]", "chapters[0].sections[0].blocks[0]", "chapters[0].sections[0].blocks[0].items[0]", "chapters[0].sections[0].blocks[0].items[2]", "chapters[0].sections[0].blocks[2]"}


def test_wrappings_and_containers_give_the_same_nodes(spark):
    forms = [{"chapters": [CHAPTER]}, {"report": {"chapters": [CHAPTER]}}, [{"chapters": [CHAPTER]}], json.dumps(json.dumps({"chapters": [CHAPTER]})), {"chapters": CHAPTER}, {"chapters": {"items": [CHAPTER]}}, {"chapters": {"ch-a": CHAPTER}}, {"chapters": {"0": CHAPTER}}]
    got = nodes(spark, *forms)
    for i in range(len(forms)):
        assert {p for r, p, *_ in got if r == f"r{i}"} == PATHS
    assert ("r0", "chapters[0].sections[0].blocks[0].items[2]", "chapters[0].sections[0].blocks[0]", "item") in got


def test_deep_wrappings_and_several_reports(spark):
    nine = {"chapters": [CHAPTER]}
    for i in range(40):
        nine = [{"body": nine}, [nine], {"report": nine}, json.dumps(nine)][i % 4] if i < 12 else {"w": [nine]}
    beside = {"meta": {"made": "[2024]", "by": "x"}, "body": {"report": None, "x": {"chapters": [CHAPTER]}}}
    got = nodes(spark, nine, beside, [{"chapters": [CHAPTER]}, None, {"tables": [{"rows": []}], "chapters": [CHAPTER]}])
    paths = lambda k: {p for r, p, *_ in got if r == k}
    assert paths("r0") == paths("r1") == PATHS and paths("r2") == PATHS | {p.replace("chapters[0]", "chapters[1]") for p in PATHS} | {"tables[0]"}


def test_member_order_of_maps(spark):
    got = nodes(spark, {"chapters": {"10": {"title": "x", "sections": None}, "2": CHAPTER}})
    assert ("r0", "chapters[1].sections[0]", "chapters[1]", "section") in got


def test_tables_rows_cells(spark):
    table = {"columns": ["A", "B", "C"], "rows": [[1, None, "x"], {"cells": ["y", None]}, {"C": None, "A": 2}, None, "text"]}
    got = {p for _, p, *_ in nodes(spark, {"tables": [table, {"columns": ["A"], "title": "no rows"}]})}
    assert got == {"tables[0]", "tables[1]", *(f"tables[0].rows[{i}]" for i in (0, 1, 2, 4)), *(f"tables[0].rows[{i}].cells[{k}]" for i, k in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 2)))}


def test_unreadable_null_and_empty(spark):
    assert nodes(spark, None, "", '{"chapters": [{"num', "7", "null", "[]", "{}", '"text"', "[" * 100_000) == set()
    df = spark.createDataFrame([], "run_id string, payload string")
    assert flatten_json(df, ["run_id"], "payload", shape_report, REPORT).count() == 0


def test_very_long_payloads_and_repeats(spark):
    big = {"chapters": [{"title": "x" * 3_000_000, "sections": []}, *([{"title": "t", "sections": []}] * 500)]}
    assert len(nodes(spark, big, big)) == 2 * 501


def test_child_rows_of_typed_lists(spark):
    df = spark.createDataFrame([(1, [{"t": "a", "b": [{"x": 1}, None, {"x": 2}]}, {"t": "c", "b": None}]), (2, None), (3, [])], "k int, a array<struct<t string, b array<struct<x int>>>>")
    assert sorted(map(tuple, child_rows(df, ["k"], "a.b").collect())) == [(1, 0, 0, 1), (1, 0, 2, 2)]
    assert sorted(map(tuple, child_rows(df, ["k"], "a").collect())) == [(1, 0, "a"), (1, 1, "c")]
