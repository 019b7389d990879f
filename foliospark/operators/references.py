"""References to records that do not exist.

Ids are a prefix and a number. The numbers of one owner scope and prefix are compressed into contiguous runs; each
referenced number is matched as-of to the run that starts at or before it and is missing when it lies beyond that
run's end. Runs hold far fewer rows than ids, and the match needs one sort, no join of references with records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import BLANK

BLOCK = 65536


def clean_id(ref: Column) -> Column:
    """Upper case, without surrounding white space and brackets; null for what is blank then."""
    bare = F.regexp_replace(ref, rf"^(?:{BLANK}|[\[\](){{}}])+|(?:{BLANK}|[\[\](){{}}])+\z", "")
    return F.nullif(F.upper(bare), F.lit(""))


def _split(df: DataFrame, id_col: str) -> DataFrame:
    """Adds stem (what stands before the last digits, with their count), number and block.

    The digit count belongs to the stem, so A1 and A01 differ; of more than 15 trailing digits the rest is stem.
    """
    digits = F.regexp_extract(id_col, r"([0-9]{1,15})\z", 1)
    return (
        df.withColumn("_d", digits)
        .withColumn("stem", F.concat(F.expr(f"substring(`{id_col}`, 1, length(`{id_col}`) - length(_d))"), F.lit("\u0000"), F.length("_d").cast("string")))
        .withColumn("num", F.coalesce(F.expr("try_cast(_d as bigint)"), F.lit(0)))
        .withColumn("block", F.expr(f"num div {BLOCK}"))
        .drop("_d")
    )


def contiguous_runs(ids: DataFrame) -> DataFrame:
    """Rows (scope, kind, stem, block, first, last): maximal runs of consecutive numbers, cut at block borders.

    Dense ranks pass over repeated ids, so none are made distinct first: one shuffle, and the runs stay where they are.
    """
    keys = ["scope", "kind", "stem", "block"]
    held = _split(ids.select("scope", "kind", "id").filter("id is not null"), "id")
    island = F.col("num") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("num"))
    return held.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("num").alias("first"), F.max("num").alias("last")).drop("_i")


def missing_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct rows of ``refs`` (scope, kind, ref, further columns) whose ref is no id of that scope and kind.

    ``ids`` has (scope, kind, id). Null refs are no references; a null scope matches nothing. Referenced ids are
    reduced to distinct ones before the match, so a hot scope or id adds rows to no single task: one task holds at
    most 65,536 numbers of one stem and as many runs. The few missing ids select the references in the end.
    """
    keys = ["scope", "kind", "stem", "block"]
    refs = refs.filter("ref is not null")
    asked = _split(refs.filter("scope is not null").select("scope", "kind", "ref").distinct(), "ref")
    runs = contiguous_runs(ids.filter("scope is not null"))
    lined = asked.select(*keys, "ref", F.col("num").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("last")).unionByName(
        runs.select(*keys, F.lit(None).cast("string").alias("ref"), F.col("first").alias("at"), F.lit(0).alias("side"), "last")
    )
    upto = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    gone = lined.withColumn("end", F.last("last", True).over(upto)).filter("side = 1 and (end is null or at > end)").select("scope", "kind", "ref")
    hit = refs.filter("scope is not null").join(gone, ["scope", "kind", "ref"], "left_semi")
    return hit.unionByName(refs.filter("scope is null")).distinct()
