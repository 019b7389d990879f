"""Reading tables, keeping the last delivery of a key, and cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANK = r"[\s\u001c-\u001f\u0085   -     　﻿]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def temp_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Working column names that clash with none of the given ones."""
    have = {c.lower() for c in taken}
    out = []
    for w in wanted:
        name = w
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def last_delivery(df: DataFrame, keys: Sequence[str], recorded: str = "ingested_at", ties: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: the delivery with the largest ``recorded``.

    Of deliveries recorded at one moment the one with the largest ``ties`` holds, then the one with the larger hash of
    the columns of ``df``, so the choice is the same on each run. Select the columns that are needed before: what is
    in ``df`` is read. A null ``recorded`` counts as earliest; null keys form one group. The row_number filter becomes
    a window group limit, which keeps one row per key and task before the shuffle, so a hot key sends few rows.
    """
    (rank,) = temp_names(df.columns, "delivery_rank")
    rest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes]).desc()
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(f"`{recorded}`").desc_nulls_last(), *[c.desc_nulls_last() for c in ties], rest)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def spread(df: DataFrame) -> DataFrame:
    """A projection of a file scan with fewer splits than the cluster has cores, dealt out to all of them; anything else as it is.

    For Python work that costs far more than moving its rows. A large table has more splits and is never shuffled. What
    kind of plan it is, its nodes say; a plan with a shuffle of its own isn't counted, since that would run it.
    """
    node = df._jdf.queryExecution().sparkPlan()
    while node.nodeName() in ("Project", "Filter", "ColumnarToRow"):
        node = node.children().head()
    if not node.nodeName().startswith(("Scan", "BatchScan")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir of the session.

    Unset, a session whose tasks all run in the driver's process gets a folder of its own there; a cluster's executors
    would each write to their own disks, so it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(scratch_dir, "own", None)
    if own is None:
        own = scratch_dir.own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table written to the shared folder, so that no later job repeats the work.

    Unlike ``checkpoint()`` it computes the rows once and stores them by column. The table lives until the JVM ends
    or ``release`` is called; a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind a frame made by ``cut``; no plan may read it afterwards."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
