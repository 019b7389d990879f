"""A keyed table in a folder that is only ever seen whole, whatever happens to its writers.

Rows lie in buckets of their key's hash. A change writes the touched buckets anew into a folder of its own, and then a
manifest that names each bucket's folder; the manifest gets its name by one rename, so readers see the table before or
after the change. The last manifests are kept: losing one loses the change, never the table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, KEPT = 64, 3


class Files:
    """The few file operations that a store needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(conf).newInstance(self.path(self.root).toUri(), conf)
        self.fs.setWriteChecksum(False)

    def names(self, folder: str = "") -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        at = self.path(f"{self.root}/{name}")
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file under its name, or nothing."""
        part = self.path(f"{self.root}/.{name.replace('/', '-')}.part")
        stream = self.fs.create(part, True)
        stream.write(text.encode())
        stream.close()
        at = self.path(f"{self.root}/{name}")
        self.fs.mkdirs(at.getParent())
        if not self.fs.rename(part, at):
            self.fs.delete(at, False)
            if not self.fs.rename(part, at):
                raise OSError(f"can't write {at}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def _manifests(files: Files) -> list[str]:
    return [n for n in files.names("manifests") if n.endswith(".json")]


def manifest(files: Files) -> dict | None:
    """The newest manifest that can be read and whose folders are all there; None for a store never written."""
    there = set(files.names("data"))
    for name in reversed(_manifests(files)):
        try:
            m = json.loads(files.read(f"manifests/{name}"))
        except ValueError:
            continue
        if set(m["folders"].values()) <= there:
            return m
    if there and _manifests(files):
        raise OSError(f"{files.root}: no manifest is whole")
    return None


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The store's rows, None if it was never written."""
    files = Files(spark, target)
    m = manifest(files)
    return None if m is None else _rows(spark, files, m, None)


def _rows(spark: SparkSession, files: Files, m: dict, buckets: list[int] | None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    paths = [f"{files.root}/data/{f}/bucket={b}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")


def change(spark: SparkSession, target: str, key: str, changed: DataFrame, merge) -> dict:
    """Replaces the rows of the touched buckets: those of ``changed``'s keys, by ``merge(held rows, changed rows)``.

    ``held`` is None for a store never written. At most 64 bucket numbers reach the driver. A writer that dies leaves
    a folder that no manifest names; the next change removes it. Merging the same rows again gives the same store.
    """
    files = Files(spark, target)
    m = manifest(files)
    buckets = m["buckets"] if m else BUCKETS
    touched = sorted(r[0] for r in changed.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    held = _rows(spark, files, m, touched) if m else None
    rows = merge(held, changed)
    number = 1 + max([int(n.split(".")[0]) for n in _manifests(files)], default=0)
    folder = f"{number:012d}"
    files.delete(f"data/{folder}")
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{files.root}/data/{folder}")
    written = {int(n.split("=")[1]) for n in files.names(f"data/{folder}") if n.startswith("bucket=")}
    folders = {b: f for b, f in (m["folders"] if m else {}).items() if int(b) not in touched} | {str(b): folder for b in written}
    new = {"buckets": buckets, "schema": rows.schema.jsonValue(), "folders": folders}
    files.write(f"manifests/{folder}.json", json.dumps(new))
    _tidy(files)
    return new


def _tidy(files: Files) -> None:
    """Removes all but the last manifests, and the folders that none of these names."""
    names = _manifests(files)
    for n in names[:-KEPT]:
        files.delete(f"manifests/{n}")
    used: set[str] = set()
    for n in names[-KEPT:]:
        try:
            used |= set(json.loads(files.read(f"manifests/{n}"))["folders"].values())
        except ValueError:
            continue
    for f in files.names("data"):
        if f not in used:
            files.delete(f"data/{f}")
