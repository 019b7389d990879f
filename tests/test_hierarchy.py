import random

from foliospark.operators.hierarchy import ancestors, descendants, nested_sets


def brute(parent):
    out = {}
    for n in parent:
        path, cur = [n], parent[n]
        while cur is not None and cur in parent and cur not in path:
            path.append(cur)
            cur = parent[cur]
        out[n] = None if cur is not None and cur in path else path[::-1]
    return out


def run(spark, parent, extra=""):
    df = spark.createDataFrame([(k, v, 1) for k, v in parent.items()], "id string, up string, depth int")
    return {r.node: r for r in nested_sets(df, "id", "up").collect()}


def check(spark, parent):
    got, want = run(spark, parent), brute({k: (v if v in parent else None) for k, v in parent.items()})
    assert set(got) == set(parent)
    for n, path in want.items():
        r = got[n]
        if path is None:
            assert r.cyclic and r.root is None and r.depth is None and r.lo is None
        else:
            below = {m for m, p in want.items() if p and n in p and m != n}
            assert (r.root, r.depth, r.path, r.descendants) == (path[0], len(path) - 1, ">".join(path), len(below))
            assert {m for m, x in got.items() if x.root == r.root and r.lo < (x.lo if x.lo is not None else -1) < r.hi} == below


def test_random_forests_with_circles(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(60)]
    check(spark, {i: rng.choice([None, *ids, "gone"]) for i in ids})
    check(spark, {f"n{i}": None if i == 0 else f"n{rng.randrange(i)}" for i in range(60)})


def test_chain_self_loop_and_tail_below_a_circle(spark):
    check(spark, {f"c{i:03}": None if i == 0 else f"c{i - 1:03}" for i in range(37)})
    check(spark, {"a": "a", "b": "a", "c": None, "d": "c", "x": "y", "y": "z", "z": "x", "t": "z"})


def test_one_parent_of_most_nodes(spark):
    got = run(spark, {"hub": None, **{f"k{i}": "hub" for i in range(300)}})
    assert got["hub"].descendants == 300 and sorted(r.lo for r in got.values()) == list(range(301))


def test_null_empty_and_repeated_rows(spark):
    assert run(spark, {}) == {}
    df = spark.createDataFrame([("a", None), ("a", "b"), ("a", "b"), (None, "a"), ("b", "")], "id string, up string")
    got = {r.node: r for r in nested_sets(df, "id", "up").collect()}
    assert set(got) == {"a", "b"} and got["a"].path == "b>a" and got["b"].depth == 0


def test_ancestors_and_descendants(spark):
    rng = random.Random(5)
    parent = {f"n{i:02}": None if i < 3 else f"n{rng.randrange(i):02}" for i in range(50)}
    sets = nested_sets(spark.createDataFrame(list(parent.items()), "id string, up string"), "id", "up").cache()
    asked, want = spark.createDataFrame([("n07",), ("n31",), ("n02",), ("none",)], "id string"), brute(parent)
    assert {(r.node, r.ancestor) for r in ancestors(sets, asked, "id").collect()} == {(n, a) for n in ("n07", "n31", "n02") for a in want[n][:-1]}
    assert {(r.node, r.descendant) for r in descendants(sets, asked, "id").collect()} == {(n, d) for n in ("n07", "n31", "n02") for d, p in want.items() if n in p[:-1]}


def test_preorder_is_the_order_of_paths_over_any_partitions(spark):
    rng = random.Random(6)
    parent = {f"n{i:03}": None if i < 2 else f"n{max(0, i - rng.choice([1, 1, 1, 9])):03}" for i in range(300)}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = run(spark, parent)
            for root in {r.root for r in got.values()}:
                mine = sorted((r for r in got.values() if r.root == root), key=lambda r: r.path.split(">"))
                assert [r.lo for r in mine] == list(range(len(mine))) and all(r.path == ">".join(brute(parent)[r.node]) for r in mine[:60])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
