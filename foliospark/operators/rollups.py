"""Totals, month groups, and rollups over several labels a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.text import tag_slug
from foliospark.operators.ranking import padded_rank, share_of_max, top_per_group


def totals(df: DataFrame, score: Column, amount: Column, flag: Column) -> DataFrame:
    """A1, A2: one row: count, sum, mean and top (0 for no rows), flagged rows. One pass, no collected lists."""
    return df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("top"), F.count_if(flag).alias("flagged"),
    )


def by_month(df: DataFrame, day: Column, stamp: str, score: Column, amount: Column) -> DataFrame:
    """A3: one row a month with its latest timestamp, by which (not by month) the groups are ordered."""
    return df.groupBy(F.substring(day, 1, 7).alias("month")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.avg(score).alias("mean"), F.max(stamp).alias("latest"))


def by_label(df: DataFrame, key: str, labels: Column, tags: Column, score: str, amount: str, top_tags: int = 6) -> DataFrame:
    """One row a label, largest first: size, mean, total, the first tags and how many more.

    A row counts under each of its labels once. Tags are made distinct before they are ranked, so no group's rows or
    tags are ever collected; only the ``top_tags`` that show are joined into one text. Ranks and shares run over the
    label rows, one for each rule.
    """
    rows = df.select(key, score, amount, F.explode(F.array_distinct(labels)).alias("label")).dropDuplicates([key, "label"])
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.sum(amount).alias("total"))
    pairs = df.select(F.explode(F.array_distinct(labels)).alias("label"), tags.alias("ts")).select("label", F.explode("ts").alias("tag")).distinct()
    counts = pairs.groupBy("label").agg(F.count("*").alias("tags"))
    first = top_per_group(pairs, "label", [F.collate("tag", "UNICODE")], top_tags).groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "tag"))), lambda s: s["tag"]), "|").alias("first_tags"))
    order = Window.orderBy(F.desc("n"), F.desc("mean"), F.collate("label", "UNICODE"))
    return (
        sizes.join(counts, "label", "left").join(first, "label", "left")
        .withColumn("place", F.row_number().over(order))
        .select(
            "label", tag_slug(F.col("label")).alias("slug"), "n", "mean", "total", F.coalesce("first_tags", F.lit("")).alias("first_tags"),
            F.greatest(F.lit(0), F.coalesce("tags", F.lit(0)) - top_tags).cast("bigint").alias("more_tags"), padded_rank(F.col("place")).alias("rank_label"),
            share_of_max(F.col("n"), F.max("n").over(Window.partitionBy())).alias("share"), (F.col("place") <= 4).alias("featured"),
        )
    )
