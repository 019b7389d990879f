"""Run folders of YAML artifacts as tables, with the digests that tell what changed."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.links import digest, manifest_actions
from foliospark.sources import store
from foliospark.tables import cut

#: bump it to parse everything again
VERSION = "1"
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _loader():
    """A YAML loader with the core rules of YAML 1.2: only true and false are booleans, no sexagesimal numbers, unique keys."""
    import yaml

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {}
    rules = (
        ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"), ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
        ("null", r"~|null|Null|NULL|", "~nN\0"), ("timestamp", r"\d{4}-\d\d?-\d\d?(?:(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?)?)?", "0123456789"),
    )
    for tag, pattern, first in rules:
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(rf"^(?:{pattern})$"), [c for c in first if c != "\0"] + ([""] if "\0" in first else []))

    def mapping(loader, node, deep=False):
        seen = set()
        for k, _ in node.value:
            name = loader.construct_object(k, deep=True)
            if name in seen:
                raise yaml.constructor.ConstructorError(None, None, f"duplicated key {name!r}", k.start_mark)
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    def integer(loader, node):
        text = node.value
        return int(text, 8) if text.startswith("0o") else int(text, 16) if "0x" in text else int(text)

    Core.add_constructor("tag:yaml.org,2002:map", lambda lo, n: mapping(lo, n, True))
    Core.add_constructor("tag:yaml.org,2002:int", integer)
    Core.add_constructor("tag:yaml.org,2002:float", lambda lo, n: float(n.value.lower().replace(".inf", "inf").replace(".nan", "nan")))
    return yaml, Core


def _plain_dates(v):
    """P5: dates and times as their ISO day; numbers that JSON lacks as null."""
    if isinstance(v, datetime.datetime):
        return (v.astimezone(datetime.UTC) if v.tzinfo else v).date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): _plain_dates(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain_dates(x) for x in v]
    return None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v


def parse_yaml(content: bytes) -> tuple[str | None, str | None]:
    """(JSON text, error) of one document; its root must be a mapping."""
    yaml, core = _loader()
    try:
        v = _plain_dates(yaml.load(content.decode("utf-8"), core))
    except (yaml.YAMLError, UnicodeDecodeError, ValueError, RecursionError) as e:
        return None, " ".join(str(e).split())[:300]
    if not isinstance(v, dict):
        return None, "root is no mapping"
    return json.dumps(v, ensure_ascii=False), None


def listing(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """(run_id, path, modified, bytes) of one artifact of every run folder under ``root``, last folder name first; no content is read.

    Folders whose names begin with a dot or underscore are left out. A missing root gives no rows; any other listing
    failure is raised, for an empty listing would prune everything.
    """
    return _binary(spark, root, artifact).select("run_id", "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("run_id"))


def _binary(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    try:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", artifact).option("recursiveFileLookup", "true").load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], _FILES)
    return raw.withColumn("run_id", F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)).filter(~F.col("run_id").rlike(r"^[._]"))


def files(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """As ``listing``, unsorted, with each file's digest and content."""
    return _binary(spark, root, artifact).select("run_id", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), digest(F.col("content"), VERSION).alias("digest"), "content")


def parsed(listing: DataFrame) -> DataFrame:
    """Adds ``doc`` (variant) and ``parse_error``; a file that can't be read has a null doc, and no job fails for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, None) if c is None else parse_yaml(c) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["run_id", "digest", "text", "parse_error"])

    out = listing.select("run_id", "digest", "content").mapInArrow(run, "run_id string, digest string, text string, parse_error string")
    return out.select("run_id", "digest", F.parse_json("text").alias("doc"), "parse_error")


def bundle(spark: SparkSession, root: str, names: dict[str, str]) -> DataFrame:
    """One row a run with each artifact's record, null where it is absent or can't be read."""
    out = None
    for column, artifact in names.items():
        part = parsed(files(spark, root, artifact)).select("run_id", F.col("doc").alias(column))
        out = part if out is None else out.join(part, "run_id", "full_outer")
    return out


def refresh(spark: SparkSession, root: str, artifact: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records after a refresh, action of each run).

    ``stored`` has (run_id, digest, text), and may have (modified, bytes): a file of the same time and size as then
    isn't read again. Others are read once: their digest is taken where they are read, and only those with a changed
    digest are parsed. A run that can't be parsed keeps the record it had; a run without the file is pruned.
    """
    if "modified" not in stored.columns:
        stored = stored.withColumns({"modified": F.lit(None).cast("timestamp"), "bytes": F.lit(None).cast("long")})
    stored = stored.select("run_id", "digest", "text", "modified", "bytes")
    seen = cut(listing(spark, root, artifact))
    known = stored.select("run_id", "modified", "bytes", F.col("digest").alias("old_digest"))
    same = cut(seen.join(known, ["run_id", "modified", "bytes"], "left_semi").select("run_id"))
    # the other sides are lists of run ids, which Spark broadcasts up to its measured threshold; beyond it the contents are shuffled once
    read = files(spark, root, artifact).join(same, "run_id", "left_anti").join(known.select("run_id", "old_digest"), "run_id", "left")
    fresh = cut(parsed(read.withColumn("content", F.when(~F.col("digest").eqNullSafe(F.col("old_digest")), F.col("content")))).select("run_id", "digest", F.to_json("doc").alias("text")))
    old = known.join(same, "run_id", "left_semi").select("run_id", F.col("old_digest").alias("digest"), F.lit(True).alias("ok"))
    now = old.unionByName(fresh.select("run_id", "digest", F.col("text").isNotNull().alias("ok")))
    actions = cut(manifest_actions(stored, now, "run_id", parsed="ok"))
    stamps = seen.select("run_id", F.col("modified").alias("m"), F.col("bytes").alias("n"))
    kept = stored.join(actions.filter("action in ('reused', 'skipped')"), "run_id").join(stamps, "run_id")
    # a skipped run keeps the time and size of the file that its record came from, so that it is tried again
    pick = lambda c, old_one: F.when(F.col("action") == "reused", F.col(c)).otherwise(F.col(old_one))
    kept = kept.select("run_id", "digest", "text", pick("m", "modified").alias("modified"), pick("n", "bytes").alias("bytes"))
    loaded = fresh.join(actions.filter("action = 'loaded'").select("run_id"), "run_id", "left_semi").join(stamps, "run_id")
    return kept.unionByName(loaded.select("run_id", "digest", "text", F.col("m").alias("modified"), F.col("n").alias("bytes"))), actions


def refresh_store(spark: SparkSession, root: str, artifact: str, target: str) -> DataFrame:
    """Refreshes the store in ``target`` (see ``store``) from the folders under ``root``; gives the action of each run.

    Only buckets with a loaded or pruned run are rewritten.
    """
    held = store.current(spark, target)
    empty = spark.createDataFrame([], "run_id string, digest string, text string, modified timestamp, bytes long")
    rows, actions = refresh(spark, root, artifact, empty if held is None else held)
    rows = cut(rows)
    touched = actions.filter("action in ('loaded', 'pruned')").select("run_id")
    if held is None or not touched.isEmpty():
        buckets = touched.select(store.bucket_of("run_id").alias("_b")).distinct()
        store.change(spark, target, "run_id", touched, lambda old, new: rows.withColumn("_b", store.bucket_of("run_id")).join(buckets, "_b", "left_semi").drop("_b"))
    return actions


def redirects(spark: SparkSession, path: str) -> DataFrame:
    """(from_run, to_run) of JSON files with one {from, to} object each; records without either are left out."""
    raw = spark.read.schema("`from` string, `to` string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.select(F.col("from").alias("from_run"), F.col("to").alias("to_run")).dropna()


def search_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of search index files, as ``feeds.write_search_index`` writes them; a file that is no array of objects gives no rows."""
    fields = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "title", "sector")] + [T.StructField("rating", T.DoubleType())] + [T.StructField(n, T.StringType()) for n in ("date", "searchText")])
    raw = spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"^\s*\["))
    return raw.select(F.explode(F.from_json("value", T.ArrayType(fields))).alias("d")).select("d.*").filter("href is not null")
