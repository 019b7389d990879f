"""Current versions, total orders, top-k, ranks, and windows by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current(df: DataFrame, status: Column) -> DataFrame:
    """all rows but the superseded; a missing status counts as current."""
    return df.filter(~status.eqNullSafe(F.lit("superseded")))


def newest(df: DataFrame, stamp: str, key: str, k: int | None = None, skip: int = 0) -> DataFrame:
    """By timestamp and key, latest first. With a limit Spark keeps k rows per task and sorts nothing globally."""
    out = df.orderBy(F.desc(stamp), F.desc(key))
    return _page(out, k, skip)


def top_rated(df: DataFrame, score: str, stamp: str, key: str, k: int | None = None, skip: int = 0) -> DataFrame:
    """O2: by score, then timestamp, then key, highest first; the key makes the order total."""
    return _page(df.orderBy(F.desc(score), F.desc(stamp), F.desc(key)), k, skip)


def _page(df: DataFrame, k: int | None, skip: int) -> DataFrame:
    if skip:
        df = df.offset(skip)
    return df if k is None else df.limit(k)


def leaders(df: DataFrame, order: Sequence[Column], k: int = 3) -> DataFrame:
    """The first ``k`` rows in order with ``rank`` and ``rank_label`` (#1...). Ranked after the limit, so one task sees k rows."""
    top = df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("rank", rank).withColumn("rank_label", F.concat(F.lit("#"), F.col("rank").cast("string")))


def rest(df: DataFrame, key: str, order: Sequence[Column], k: int = 3) -> DataFrame:
    """The rows after the leaders; all rows if there are no more than ``k``. Leaders are at most ``k`` rows, so they are broadcast."""
    first = df.orderBy(*order).limit(k + 1)
    ranked = first.select(F.col(key).alias("_leader"), F.row_number().over(Window.orderBy(*order)).alias("_at"), F.count("*").over(Window.partitionBy()).alias("_n"))
    leaders_only = ranked.filter(f"_n > {k} and _at <= {k}").select("_leader")
    return df.join(F.broadcast(leaders_only), df[key] == F.col("_leader"), "left_anti")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows of each group (None: all) with ``position``; the window group limit prunes before the shuffle."""
    placed = df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed if k is None else placed.filter(F.col("position") <= k)


def padded_rank(rank: Column, width: int = 2) -> Column:
    """A rank with leading zeros, never cut."""
    return F.lpad(rank.cast("string"), F.greatest(F.lit(width), F.length(rank.cast("string"))), F.lit("0"))


def share_of_max(n: Column, most: Column) -> Column:
    """A whole percentage of the largest value, halves up; the largest counts as at least 1."""
    return F.floor(F.lit(100) * n / F.greatest(F.lit(1), most) + 0.5).cast("bigint")


def contains(df: DataFrame, text: Column, query: str) -> DataFrame:
    """rows whose lower-case text holds the query literally; no rows for a blank query."""
    q = query.strip().lower()
    return df.filter(F.contains(F.lower(text), F.lit(q))) if q else df.limit(0)


def running_total(df: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """The sum up to and with each row."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
