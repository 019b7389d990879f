"""Histories of changing attributes: a ledger with valid and recorded times, and the versions it holds true now.

A delivery says: from ``valid_from`` on, this entity has these attributes. It is recorded later, sometimes after
deliveries for later moments. A late delivery splits the interval that was believed to cover its moment. Swept in the
order of valid time, the interval that it splits starts at the nearest earlier moment that was already recorded
(previous-smaller element of the recorded times), and it ends at the nearest later moment already recorded. Nothing is
overwritten: each belief keeps the period in which it was held.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import cut


def shifted(df: DataFrame, entity: str, bucket: str, order: str, value: str, out: str, ahead: bool) -> DataFrame:
    """Adds ``out``: ``value`` of the entity's next (``ahead``) or previous row in the order of (bucket, order).

    An entity's rows are never sorted in one task: rows are compared within their bucket, and only one row per
    bucket takes part in the step from bucket to bucket. ``bucket`` must not decrease along ``order``.
    """
    step = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    inner = Window.partitionBy(entity, bucket).orderBy(order)
    outer = Window.partitionBy(entity).orderBy(bucket)
    held = F.struct(F.col(value).alias("v"))
    local = df.withColumn("_near", step(held).over(inner))
    edges = df.groupBy(entity, bucket).agg(pick(held, F.col(order)).alias("_edge"))
    edges = edges.withColumn("_far", step("_edge").over(outer)).drop("_edge")
    return local.join(edges, [entity, bucket], "left").withColumn(out, F.coalesce("_near", "_far")["v"]).drop("_near", "_far")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each (entity, bucket): the nearest earlier and later moments recorded no later. Input is sorted."""
    names = ["entity", "bucket", "moment", "first"]
    group, moments, firsts = None, [], []

    def flush():
        n = len(moments)
        before, after = [None] * n, [None] * n
        stack: list[int] = []
        for i in range(n):
            while stack and firsts[stack[-1]] > firsts[i]:
                stack.pop()
            before[i] = moments[stack[-1]] if stack else None
            stack.append(i)
        stack = []
        for i in range(n - 1, -1, -1):
            while stack and firsts[stack[-1]] > firsts[i]:
                stack.pop()
            after[i] = moments[stack[-1]] if stack else None
            stack.append(i)
        return pa.RecordBatch.from_pydict(
            {"entity": pa.array([group[0]] * n, pa.string()), "bucket": pa.array([group[1]] * n, pa.string()), "moment": pa.array(moments, pa.string()), "first": pa.array(firsts, pa.int64()), "before": pa.array(before, pa.string()), "after": pa.array(after, pa.string())}
        )

    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for e, b, m, f in zip(*(batch.column(n).to_pylist() for n in names)):
            if (e, b) != group:
                if moments:
                    waiting.append(flush())
                    rows += len(moments)
                    if rows > 20_000:
                        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                        waiting, rows = [], 0
                group, moments, firsts = (e, b), [], []
            moments.append(m)
            firsts.append(f)
    if moments:
        waiting.append(flush())
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _sweep_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asking moment the nearest earlier (or, ``ahead``, later) bucket with something recorded no later.

    Rows are sorted along each (entity, direction), a bucket's askers before the bucket itself, which has no moment.
    The stack holds the buckets passed that no nearer one undercuts, so a binary search finds the answer; it has at
    most one entry a bucket.
    """
    group, buckets, leasts = None, [], []
    for b in batches:
        out = []
        for e, ahead, bucket, moment, first in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (e, ahead) != group:
                group, buckets, leasts = (e, ahead), [], []
            if moment is None:
                while leasts and leasts[-1] >= first:
                    leasts.pop()
                    buckets.pop()
                leasts.append(first)
                buckets.append(bucket)
            elif k := bisect_right(leasts, first):
                out.append((e, moment, first, ahead, buckets[k - 1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()))], names=["entity", "moment", "first", "ahead", "near"])


def bitemporal_ledger(df: DataFrame, entity: str, moment: str, recorded: str, attributes: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Rows (entity, attributes, valid_from, valid_to, recorded_from, recorded_to) of every belief ever held.

    ``moment`` is a sortable string, ``recorded`` a timestamp. valid_to is null for an open interval, recorded_to is
    null while the belief holds. Rows without entity or moment can't be placed and give nothing; a null ``recorded``
    counts as the beginning of time. Repeated deliveries with equal content at one moment give one belief; of
    different ones recorded together the one with the larger hash holds. An empty table gives an empty ledger.
    Other columns of ``df`` are ignored, whatever their names.

    ``bucket`` (by default the first eight characters of the moment, a day) bounds how many moments of an entity one
    task holds: with moments to the second at most 86,400 a bucket. Steps between buckets use one row per bucket.
    """
    day = F.substring(F.col(f"`{moment}`"), 1, 8) if bucket is None else bucket
    rec = F.coalesce(F.col(f"`{recorded}`").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    given = df.select(
        F.col(f"`{entity}`").cast("string").alias("entity"),
        F.col(f"`{moment}`").alias("moment"),
        day.alias("bucket"),
        rec.alias("rec"),
        F.struct(*[F.col(f"`{a}`").alias(a) for a in attributes]).alias("attrs"),
    ).filter("entity is not null and moment is not null")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', rec)")
    firsts = cut(given.groupBy("entity", "bucket", "moment").agg(F.min(micros).alias("first")))
    swept = cut(
        firsts.repartition("entity", "bucket")
        .sortWithinPartitions("entity", "bucket", "moment")
        .mapInArrow(_sweep, "entity string, bucket string, moment string, first long, before string, after string")
    )
    days = firsts.groupBy("entity", "bucket").agg(F.min("first").alias("first")).withColumn("moment", F.lit(None).cast("string"))
    ends = swept.filter("before is null or after is null")
    lines = [days.withColumn("ahead", F.lit(x)).unionByName(ends.filter(f"{side} is null").select("entity", "bucket", "first", "moment", F.lit(x).alias("ahead"))) for side, x in (("before", False), ("after", True))]
    along = [F.when(~F.col("ahead"), F.col("bucket")), F.when(F.col("ahead"), F.col("bucket")).desc(), F.col("moment").desc_nulls_last()]
    steps = lines[0].unionByName(lines[1]).repartition("entity", "ahead").sortWithinPartitions("entity", "ahead", *along)
    open_ends = steps.select("entity", "ahead", "bucket", "moment", "first").mapInArrow(_sweep_days, "entity string, moment string, first long, ahead boolean, near string")
    asked = open_ends.select("entity", F.col("near").alias("bucket"), "first", F.col("moment").alias("asker"), (~F.col("ahead")).alias("backward"))
    base = firsts.select("entity", "bucket", "first", F.lit(None).cast("string").alias("asker"), F.lit(None).cast("boolean").alias("backward"), "moment")
    upto = Window.partitionBy("entity", "bucket").orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    found = (
        base.unionByName(asked.withColumn("moment", F.lit(None).cast("string")))
        .withColumn("hi", F.max("moment").over(upto))
        .withColumn("lo", F.min("moment").over(upto))
        .filter("asker is not null")
        .groupBy("entity", F.col("asker").alias("moment"))
        .agg(F.max(F.when(F.col("backward"), F.col("hi"))).alias("far_before"), F.max(F.when(~F.col("backward"), F.col("lo"))).alias("far_after"))
    )
    placed = swept.join(found, ["entity", "moment"], "left").select(
        "entity", "moment", "first", F.coalesce("before", "far_before").alias("before"), F.coalesce("after", "far_after").alias("after")
    )
    at = F.expr("timestampadd(MICROSECOND, first, timestamp_ntz'1970-01-01 00:00:00')")
    none = F.lit(None)
    kinds = given.select("attrs").schema["attrs"].dataType
    told = given.select("entity", "moment", "rec", F.lit(0).alias("kind"), "attrs", none.cast("string").alias("until"))
    born = placed.select("entity", "moment", at.alias("rec"), F.lit(1).alias("kind"), none.cast(kinds).alias("attrs"), F.col("after").alias("until"))
    split = placed.filter("before is not null").select("entity", F.col("before").alias("moment"), at.alias("rec"), F.lit(2).alias("kind"), none.cast(kinds).alias("attrs"), F.col("moment").alias("until"))
    events = told.unionByName(born).unionByName(split)
    order = Window.partitionBy("entity", "moment").orderBy("rec", "kind", F.xxhash64("attrs"), F.col("until").desc())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("attrs", F.last("attrs", True).over(so_far))
        .withColumn("valid_to", F.last("until", True).over(so_far))
        .withColumn("recorded_to", F.lead("rec").over(order))
        .filter("recorded_to is null or recorded_to > rec")
        .select("entity", "attrs.*", F.col("moment").alias("valid_from"), "valid_to", F.col("rec").alias("recorded_from"), "recorded_to")
    )


def versions(ledger: DataFrame, attributes: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """What holds now, with neighbouring intervals of equal attributes joined: entity, attributes, valid_from, valid_to.

    Attributes are compared as values, null and null being equal. ``bucket`` is that of the ledger, of ``valid_from``.
    """
    part = F.substring("valid_from", 1, 8) if bucket is None else bucket
    now = cut(ledger.filter("recorded_to is null").select("entity", *[f"`{a}`" for a in attributes], "valid_from", part.alias("_day"), F.struct(*[F.col(f"`{a}`") for a in attributes], F.lit(True)).alias("_print")))
    starts = shifted(now, "entity", "_day", "valid_from", "_print", "_prior", ahead=False).filter(~F.col("_prior").eqNullSafe(F.col("_print"))).drop("_prior", "_print")
    return shifted(starts, "entity", "_day", "valid_from", "valid_from", "valid_to", ahead=True).drop("_day")
