"""Filling containers of fixed capacity: shortest-pack-first over the histogram of lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver. Lengths are placed from the longest to the shortest,
each into the emptiest packing patterns that still take it, as many containers at once as the counts allow. The
patterns then say which ranks of each length go to which containers, and items find their container by their rank.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: items that one task ranks, of one length at most
RANKED = 200_000
#: size up to which the ranges go to the tasks by broadcast, and that of one range
BROADCAST_BYTES, RANGE_BYTES = 8_000_000, 40


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """(containers, lengths in each) for all items of 1..capacity; lengths with their multiplicity."""
    room: dict[int, list[list]] = {}  # free space -> patterns [count, lengths]
    free: list[int] = []  # heap of -free space, may name emptied ones
    closed: list[tuple[int, Counter]] = []

    def keep(space: int, count: int, lengths: Counter) -> None:
        if space == 0:
            closed.append((count, lengths))
            return
        if not room.get(space):
            room[space] = []
            heapq.heappush(free, -space)
        room[space].append([count, lengths])

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        left = histogram[length]
        while left:
            while free and not room.get(-free[0]):
                heapq.heappop(free)
            if not free or -free[0] < length:
                each = capacity // length  # nothing open takes it: as many of this length in one container as fit
                full, rest = divmod(left, each)
                if full:
                    keep(capacity - each * length, full, Counter({length: each}))
                if rest:
                    keep(capacity - rest * length, 1, Counter({length: rest}))
                break
            space = -free[0]
            count, lengths = room[space].pop()
            used = min(count, left)
            if count > used:
                room[space].append([count - used, lengths])
            keep(space - length, used, lengths + Counter({length: 1}))
            left -= used
    return closed + [(c, p) for ps in room.values() for c, p in ps]


def rank_ranges(patterns: list[tuple[int, Counter]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first container, items of this length in each container)."""
    taken: Counter = Counter()
    out, base = [], 0
    for count, lengths in patterns:
        for length, each in sorted(lengths.items()):
            first = taken[length]
            taken[length] += count * each
            out.append((length, first, taken[length] - 1, base, each))
        base += count
    return out


def pack(sizes: DataFrame, item: str, size: str, containers: list[tuple[str, int]]) -> DataFrame:
    """Rows (container_kind, container_id, item, piece, size, first_unit): every item in a container of each kind.

    ``containers`` are (kind, capacity); kinds without a positive capacity give nothing. An item larger than a capacity
    is cut into full pieces and a rest; pieces count from 0 and start at unit ``first_unit``. All others stay whole.
    Items of size 0 or null use no space and lie in container 0. Repeated items are packed each. An empty table gives
    no rows. Equal sizes are told apart by item and a row hash, so the result doesn't depend on the partitioning,
    except among repeated items, which are interchangeable.

    A length that very many items share is ranked in as many buckets as keep each under some 200,000 items. The ranges
    go to the tasks by broadcast up to 8 MB, as measured, else by a join; the rows are the same.
    """
    spark: SparkSession = sizes.sparkSession
    src = sizes.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"))
    kinds = [(k, int(c)) for k, c in containers if c is not None and int(c) > 0]
    spec = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds]) if kinds else F.expr("cast(array() as array<struct<kind:string,cap:bigint>>)")
    pieces = (
        src.select("item", "size", F.explode(spec).alias("s"))
        .select("item", F.col("s.kind").alias("kind"), F.col("s.cap").alias("cap"), F.col("size").alias("whole"), F.explode(F.expr("sequence(0L, greatest(0L, (size - 1) div s.cap))")).alias("piece"))
        .select("item", "kind", "piece", (F.col("piece") * F.col("cap")).alias("first_unit"), F.least("cap", F.col("whole") - F.col("piece") * F.col("cap")).alias("n"))
    )
    buckets = 1 + src.count() // RANKED
    bucketed = pieces.withColumn("b", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)))
    counts = bucketed.filter("n > 0").groupBy("kind", "n", "b").agg(F.count("*").alias("c"))
    histograms: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in counts.groupBy("kind", "n").agg(F.sum("c").alias("c")).collect():
        histograms[r["kind"]][r["n"]] = r["c"]
    ranges = [(k, *x) for k, c in kinds for x in rank_ranges(packing_patterns(histograms[k], c))]
    by_length: dict[tuple[str, int], list] = {}
    for k, length, lo, hi, base, each in ranges:
        by_length.setdefault((k, length), []).append((lo, hi, base, each))
    table = spark.createDataFrame([(k, n, v) for (k, n), v in by_length.items()], "kind string, n long, spots array<struct<lo:long,hi:long,base:long,each:long>>")
    if len(ranges) * RANGE_BYTES <= BROADCAST_BYTES:
        table = F.broadcast(table)
    before = Window.partitionBy("kind", "n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("kind", "n", "b").orderBy("item", "piece")
    ranked = bucketed.filter("n > 0").withColumn("at", F.row_number().over(inside) - 1).join(starts, ["kind", "n", "b"]).withColumn("rank", F.col("ahead") + F.col("at"))
    spot = F.expr("filter(spots, s -> s.lo <= rank and rank <= s.hi)[0]")
    placed = ranked.join(table, ["kind", "n"]).withColumn("spot", spot).select("kind", F.expr("spot.base + (rank - spot.lo) div spot.each").alias("container_id"), "item", "piece", "n", "first_unit")
    empty = bucketed.filter("n = 0").select("kind", F.lit(0).cast("long").alias("container_id"), "item", "piece", "n", "first_unit")
    return placed.unionByName(empty).select(F.col("kind").alias("container_kind"), "container_id", F.col("item").alias(item), "piece", F.col("n").alias("size"), "first_unit")
