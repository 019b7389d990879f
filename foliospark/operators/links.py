"""Overlays, lookups with fallback, manifests, and integrity checks over edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from foliospark.tables import strip, temp_names


def present(x: Column, is_list: bool = False) -> Column:
    """A text that isn't blank, or a list that isn't empty; else null."""
    return F.when(F.size(x) > 0, x) if is_list else F.when(strip(x) != "", x)


def overlaid(base: DataFrame, overlay: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Base rows with each field (base name to overlay name) from the overlay where it has a text that isn't blank or a list that isn't empty."""
    o = overlay.select(F.col(key).alias("_k"), *[present(F.col(v), isinstance(overlay.schema[v].dataType, ArrayType)).alias(f"_{b}") for b, v in fields.items()])
    pick = {b: F.coalesce(f"_{b}", b) for b in fields}
    return base.join(o, base[key] == o["_k"], "left").withColumns(pick).select(*base.columns)


def entries_of_paths(paths: DataFrame, path: str, entries: DataFrame, folder: str) -> DataFrame:
    """Each page path with the entry whose folder it names, whatever base and locale stand before; inner."""
    (last,) = temp_names([*paths.columns, *entries.columns], "path_folder")
    return paths.withColumn(last, F.regexp_extract(path, r"([^/]+)/*\z", 1)).join(entries, F.col(last) == F.col(folder)).drop(last)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; on a table that is sorted or partitioned by the key, the only ones that the scan reads."""
    return df.filter(F.col(key) == F.lit(value))


def looked_up(df: DataFrame, table: DataFrame, on: Sequence[str], value: str, fallback: str, out: str) -> DataFrame:
    """Df with the table's value under ``out``; where no row matches, the fallback column's text.

    No broadcast is forced: Spark takes a small table's own measured size, and AQE splits a skewed key otherwise.
    """
    t = table.select(*on, F.col(value).alias("_v"))
    return df.join(t, list(on), "left").withColumn(out, F.coalesce(F.col("_v"), F.col(fallback).cast("string"))).drop("_v")


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key the other table lacks."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def digest(content: Column, version: str) -> Column:
    """sha1 of the version, a zero byte, and the content."""
    return F.sha1(F.concat(F.lit(version.encode()), F.lit(b"\0"), content.cast("binary")))


def manifest_actions(stored: DataFrame, seen: DataFrame, key: str, print_col: str = "digest", parsed: str | None = None) -> DataFrame:
    """What a refresh does with each key: reused, loaded, skipped or pruned.

    ``seen`` lists all keys that exist now. A key whose content can't be read (``parsed`` false) keeps its stored row
    if it has one, and counts as skipped; a stored key that is no longer seen is pruned. An empty ``seen`` prunes all.
    """
    s = stored.select(F.col(key).alias("k"), F.col(print_col).alias("was"))
    n = seen.select(F.col(key).alias("k"), F.col(print_col).alias("is"), (F.col(parsed) if parsed else F.lit(True)).alias("ok"))
    action = (
        F.when(F.col("ok").isNull(), "pruned").when(F.col("was").isNotNull() & (F.col("was") == F.col("is")), "reused").when(F.col("ok"), "loaded").otherwise("skipped")
    )
    return s.join(n, "k", "full_outer").select(F.col("k").alias(key), action.alias("action"), F.col("was").isNotNull().alias("was_stored"))


def check_actions(seen: DataFrame, cache: DataFrame, key: str, print_col: str, version_col: str, version: str) -> DataFrame:
    """V8: what a check does with each key of ``seen``: (key, action).

    ``cache`` has the digest and rule version of the keys that passed; failures are never in it. ``skip`` only where
    digest and version are those of the cached pass, else ``new``, ``changed`` or ``version``.
    """
    c = cache.select(F.col(key).alias("_k"), F.col(print_col).alias("_was"), F.col(version_col).alias("_v"))
    action = F.when(F.col("_k").isNull(), "new").when(~F.col(print_col).eqNullSafe(F.col("_was")), "changed").when(~F.col("_v").eqNullSafe(F.lit(version)), "version").otherwise("skip")
    return seen.join(c, seen[key] == c["_k"], "left").select(key, action.alias("action"))


def unresolved_edges(edges: DataFrame, nodes: DataFrame, end: str, node: str) -> DataFrame:
    """Edges whose end is no node, or more than one. Adds ``matches``, how many nodes bear the key."""
    counts = nodes.groupBy(F.col(node).alias("_n")).agg(F.count("*").alias("_c"))
    return edges.join(counts, edges[end] == counts["_n"], "left").withColumn("matches", F.coalesce("_c", F.lit(0)).cast("bigint")).filter("matches <> 1").drop("_n", "_c")


def cells_with_headers(df: DataFrame, keys: Sequence[str], cells: str, headers: Sequence[str]) -> DataFrame:
    """One row a cell with its position and the header at that position, null beyond the headers."""
    table = F.array(*map(F.lit, headers)) if headers else F.expr("cast(array() as array<string>)")
    return df.select(*keys, F.posexplode(cells).alias("pos", "cell")).withColumn("header", F.get(table, F.col("pos")))
