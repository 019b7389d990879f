"""Parent-child links to nested sets: root, depth, path, preorder range and descendants of each node.

Links are followed by doubling: after k rounds each node knows its ancestor 2**k steps up, so a tree of depth d takes
about log2(d) rounds, not d. Subtree sizes are summed upward along the doubled links, children get disjoint preorder
ranges by prefix sums over their siblings in the order of their names, and offsets are summed downward along the same
links. A node that no round brings to a root stands on a circle of links, or below one. Paths, ancestors and
descendants are then read off the ranges, in one sweep along them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import cut, release


def nested_sets(df: DataFrame, node: str, parent: str, sep: str = ">") -> DataFrame:
    """Rows (node, parent, root, depth, path, lo, hi, descendants, cyclic), one for each node.

    [lo, hi) is the node's preorder range within its root, siblings in the order of their names; its descendants are the
    nodes of the root with lo < their lo < hi. Null nodes give nothing; of repeated nodes the smallest non-null parent
    holds; a parent that is no node counts as none; a node that is its own parent is a circle. Cyclic nodes, and nodes
    below a circle, have null root, depth, path, lo, hi and descendants. An empty table gives no rows; other columns
    are ignored.

    Each round is one join and one aggregation of all nodes on evenly spread keys: sizes are summed map-side before the
    shuffle, and the join on the ancestor may be split by AQE where one ancestor is common. Siblings are numbered in
    ranges of their order, one row a range and parent being added up, so many tasks share a parent with very many
    children. Paths are built once, by tasks that each sweep a stretch of the preorder (see ``paths``).
    """
    raw = df.select(F.col(f"`{node}`").cast("string").alias("node"), F.col(f"`{parent}`").cast("string").alias("parent")).filter("node is not null")
    nodes = raw.groupBy("node").agg(F.min("parent").alias("parent"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    state = cut(
        nodes.select(
            "node", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
            F.coalesce("parent", "node").alias("top"), F.lit(1).cast("long").alias("size"),
        )
    )
    before, rounds = -1, 0
    while True:
        active = state.filter("up is not null").count()
        if active == 0 or active == before:
            break
        before, rounds = active, rounds + 1
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
        below = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        grown = (
            state.join(above, "up", "left")
            .select(
                "node", "parent", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                F.coalesce("top2", "top").alias("top"), "size",
            )
            .join(below, "node", "left")
            .select("node", "parent", "up", "depth", "top", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
        grown = cut(grown)
        release(state)
        state = grown
    cyclic = F.col("up").isNotNull()
    sized = state.filter(~cyclic).select("node", "parent", "size")
    kids = numbered = cut(sized.filter("parent is not null").repartitionByRange("parent", "node").withColumn("b", F.spark_partition_id()))
    inner = Window.partitionBy("parent", "b").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kids.groupBy("parent", "b").agg(F.sum("size").alias("block")).withColumn("ahead", F.coalesce(F.sum("block").over(outer), F.lit(0))).drop("block")
    kids = kids.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(blocks, ["parent", "b"])
    down = cut(
        kids.select("node", F.col("parent").alias("up"), (1 + F.col("ahead") + F.col("within")).alias("lo")).unionByName(
            sized.filter("parent is null").select("node", F.col("parent").alias("up"), F.lit(0).cast("long").alias("lo"))
        )
    )
    last = down
    if active:  # the last round moved nothing but circles
        rounds -= 1
    for k in range(rounds):
        above = down.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("lo").alias("lo2"))
        moved = down.join(above, "up", "left").select("node", F.col("up2").alias("up"), (F.col("lo") + F.coalesce("lo2", F.lit(0))).alias("lo"))
        if k < rounds - 1:
            moved = cut(moved)
            release(down)
            last = moved
        down = moved
    found = state.join(down.select("node", "lo"), "node", "left").select(
        "node", "parent", F.when(~cyclic, F.col("top")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), "lo", (F.col("lo") + F.col("size")).alias("hi"), cyclic.alias("cyclic")
    )
    named = paths(found, sep)
    for spent in (state, numbered, last):
        release(spent)
    return named.select("node", "parent", "root", "depth", "path", "lo", "hi", (F.col("hi") - F.col("lo") - 1).alias("descendants"), "cyclic")


def ancestors(sets: DataFrame, of: DataFrame, node: str) -> DataFrame:
    """Rows (node, ancestor) for each node in ``of``: the nodes of its root whose range holds its place.

    A range of size n holds the places of all n - 1 nodes below, so a join on the ranges meets exactly the answers'
    candidates of one root; for few asked nodes. For all nodes of a table sweep once with ``paths``.
    """
    want = of.select(F.col(f"`{node}`").cast("string").alias("node")).distinct().join(sets.select("node", "root", F.col("lo").alias("place")), "node")
    above = sets.filter("hi - lo > 1").select("root", "lo", "hi", F.col("node").alias("ancestor"))
    return want.join(above, "root").filter("lo < place and place < hi").select("node", "ancestor")


def descendants(sets: DataFrame, of: DataFrame, node: str) -> DataFrame:
    """Rows (node, descendant) for each node in ``of``: the nodes of its root whose place its range holds."""
    want = of.select(F.col(f"`{node}`").cast("string").alias("node")).distinct().join(sets.select("node", "root", "lo", "hi"), "node").filter("hi - lo > 1")
    return want.join(sets.select("root", F.col("lo").alias("place"), F.col("node").alias("descendant")), "root").filter("lo < place and place < hi").select("node", "descendant")


def paths(sets: DataFrame, sep: str = ">") -> DataFrame:
    """Adds ``path``, the names from the root to each node; null for a node without a root.

    Nodes are laid out in preorder over the tasks. A task sweeps its stretch with a stack of the ranges that are open;
    what is open where a stretch begins are the ranges that hold its first place, met by one row a task; only ranges
    that reach over the end of their own task can.
    """
    laid = cut(sets.repartitionByRange("root", "lo").withColumn("task", F.spark_partition_id()))
    heads = laid.filter("root is not null").groupBy("task").agg(F.min(F.struct("root", "lo")).alias("h")).select("task", F.col("h.root").alias("root"), F.col("h.lo").alias("place"))  # one row a task
    after = heads.withColumn("next", F.lead(F.struct("root", "place")).over(Window.orderBy("task"))).select("task", "next")
    # of a task's nodes only those that are still open where the next one begins, no more than the depth
    going_on = laid.filter("hi - lo > 1").join(F.broadcast(after), "task").filter("next.root = root and next.place < hi").select("root", "lo", "hi", "node")
    above = going_on.join(F.broadcast(heads), "root").filter("lo < place and place < hi")
    open_there = above.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "node"))).alias("open"))  # no more than the depth
    first = heads.join(open_there, "task", "left").select("task", F.col("place").alias("lo"), "root", "open")
    given = laid.join(F.broadcast(first), ["task", "root", "lo"], "left").repartition("task").sortWithinPartitions("task", "root", "lo")
    columns = sets.columns

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, root, stack = None, None, []  # of (hi, path)
        for b in batches:
            out = []
            for t, r, lo, hi, n, opened in zip(*(b.column(c).to_pylist() for c in ("task", "root", "lo", "hi", "node", "open"))):
                if r is None:
                    out.append(None)
                    continue
                if t != task or r != root:
                    stack = []
                    if t != task:
                        for o in opened or []:
                            stack.append((o["hi"], f"{stack[-1][1]}{sep}{o['node']}" if stack else o["node"]))
                    task, root = t, r
                while stack and stack[-1][0] <= lo:
                    stack.pop()
                out.append(f"{stack[-1][1]}{sep}{n}" if stack else n)
                if hi - lo > 1:
                    stack.append((hi, out[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "path"])

    kinds = ", ".join(f"{n} {t}" for n, t in sets.dtypes)
    return given.select("task", "open", *columns).mapInArrow(sweep, f"{kinds}, path string")
