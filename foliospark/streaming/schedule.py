"""Which jobs are due at which hours, and a stream that refreshes a store from arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Jobs and the hours (UTC) at which they are due: every sixth, every second, and hour 2.
RULES = {"research": lambda h: h % 6 == 0, "translate": lambda h: h % 2 == 0, "refresh": lambda h: h == 2}


def due(at: Column) -> Column:
    """the jobs due at a moment: none off the full hour."""
    hits = F.array_compact(F.array(*[F.when(rule(F.hour(at)), name) for name, rule in RULES.items()]))
    return F.when(F.minute(at) == 0, hits).otherwise(F.array().cast("array<string>"))


def due_between(df: DataFrame, first: str, last: str) -> DataFrame:
    """(at, job) for each full hour from ``first`` to ``last`` of each row, both included."""
    hours = df.select(F.explode(F.sequence(F.date_trunc("hour", F.col(first)), F.date_trunc("hour", F.col(last)), F.expr("interval 1 hour"))).alias("at"))
    return hours.select("at", F.explode(due(F.col("at"))).alias("job"))


def refresh_stream(spark: SparkSession, source: str, schema: T.StructType, key: str, recorded: str, target: str, checkpoint: str) -> StreamingQuery:
    """T1 as a stream: arriving JSON records update a Parquet store, the last by ``recorded`` of each key.

    It takes what is there and ends (availableNow). A micro-batch rewrites only the buckets that its keys fall into
    (see ``store.change``); a repeated batch gives the same rows again, so neither a crash nor a lost checkpoint loses
    or doubles any.
    """
    from foliospark.sources import store
    from foliospark.tables import last_delivery

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[f.name for f in schema.fields])
        latest = lambda held, new: last_delivery(new if held is None else held.unionByName(new), [key], recorded)
        store.change(batch.sparkSession, target, key, rows, latest)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_store(spark: SparkSession, target: str) -> DataFrame | None:
    """The store's last whole version, None before the first."""
    from foliospark.sources import store

    return store.current(spark, target)
