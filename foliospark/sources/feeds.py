"""What a site publishes, as rows: feed items, sitemap addresses, redirect routes, search documents; and their files."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import format_datetime
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.coerce import run_parts
from foliospark.functions.text import locale_path
from foliospark.sources import store

# The pages that a sitemap lists besides the runs'.
PAGES = ["/", "/archive/", "/sectors/", "/top-rated/", "/search/"]


def search_documents(cards: DataFrame, base: str = "/", locale: str = "en") -> DataFrame:
    """Names and sectors are English in both locales; only the address differs."""
    return cards.select(
        locale_path(F.lit(base), F.lit(locale), F.col("folder_slug")).alias("href"), F.col("company.name").alias("title"), F.coalesce("company.sector", F.lit("")).alias("sector"),
        F.col("overall_score").alias("rating"), F.col("run_date").alias("date"), F.lower("company.name").alias("search_text"),
    )


def feed_items(cards: DataFrame, locale: Column) -> DataFrame:
    """K3."""
    return cards.select(F.col("company.name").alias("title"), F.col("headline").alias("description"), F.col("run_date").alias("pub_date"), locale_path(F.lit("/"), locale, F.col("folder_slug")).alias("link"))


def sitemap(cards: DataFrame, site: str) -> DataFrame:
    """Addresses of all pages and all runs, superseded ones too, in both locales."""
    spark = cards.sparkSession
    pages = spark.createDataFrame([(p,) for p in PAGES], "path string").unionByName(cards.select(F.concat(F.lit("/"), "folder_slug", F.lit("/")).alias("path")))
    both = pages.select(F.explode(F.array("path", F.concat(F.lit("/zh"), "path"))).alias("path"))
    return both.select(F.concat(F.lit(site.rstrip("/")), "path").alias("loc"), F.concat(F.lit("<url><loc>" + site.rstrip("/")), "path", F.lit("</loc></url>")).alias("xml"))


def redirect_routes(pairs: DataFrame, base: str = "/") -> DataFrame:
    """K6: two routes, one a locale, for each (from_run, to_run)."""
    prefix = base if base.endswith("/") else base + "/"
    old, new = run_parts(F.col("from_run"))[1], run_parts(F.col("to_run"))[1]
    route = lambda a, b: F.struct(F.concat(F.lit(a), old, F.lit("/")).alias("route"), F.concat(F.lit(prefix + b), new, F.lit("/")).alias("target"))
    return pairs.select(F.explode(F.array(route("/", ""), route("/zh/", "zh/"))).alias("r")).select("r.*")


def _enclosed(rows: DataFrame, column: str, head: str, tail: str, between: str) -> DataFrame:
    """The texts of a column as lines of files: each task's begin with ``head`` and end with ``tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = head
        for b in batches:
            lines = []
            for x in b.column(0).to_pylist():
                lines.append(line + x)
                line = between
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(head if line == head else "") + tail], pa.string())], names=["value"])

    return rows.select(column).mapInArrow(run, "value string")


def write_search_index(documents: DataFrame, path: str, files: int | None = None) -> None:
    """K2: files that are JSON arrays of documents each, one a task, or as many as ``files`` says; 1 gives the single file that a page fetches."""
    named = documents.withColumnRenamed("search_text", "searchText")
    rows = named.select(F.to_json(F.struct(*named.columns), {"ignoreNullFields": "false"}).alias("j"))
    _enclosed(rows if files is None else rows.repartition(files), "j", "[", "]", ",").write.mode("overwrite").text(path)


def rfc_822(day: str | None) -> str | None:
    """A day as feeds write dates: its midnight in UTC; None for what is no day."""
    try:
        return format_datetime(datetime.fromisoformat(day[:10]).replace(tzinfo=UTC), usegmt=True) if day else None
    except ValueError:
        return None


def write_rss(items: DataFrame, path: str, title: str, site: str, limit: int) -> None:
    """K3: XML files of at most ``limit`` items in order: ``path``, then its name with -2, -3 and so on; one file's items are held at a time.

    On whatever file system ``path`` names; each file gets its name when it is whole.
    """
    folder, name = os.path.split(path)
    stem, ext = os.path.splitext(name)
    out = store.Files(items.sparkSession, folder)
    part, body = 1, []

    def put():
        out.write(name if part == 1 else f"{stem}-{part}{ext}", f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(site)}</link>{"".join(body)}</channel></rss>')

    for r in items.toLocalIterator():
        if len(body) == limit:
            put()
            part, body = part + 1, []
        day = rfc_822(r["pub_date"])
        date = f"<pubDate>{day}</pubDate>" if day else ""
        body.append(f"<item><title>{escape(r['title'] or '')}</title><description>{escape(r['description'] or '')}</description>{date}<link>{escape(site.rstrip('/') + r['link'])}</link></item>")
    put()
    later = re.compile(rf"{re.escape(stem)}-(\d+){re.escape(ext)}")
    for old in out.names():
        if (m := later.fullmatch(old)) and int(m[1]) > part:
            out.delete(old)


def write_sitemap(addresses: DataFrame, path: str, most: int = 50_000) -> None:
    """K4: sitemap files of at most ``most`` addresses, and sitemap-index.xml, which names them."""
    files = max(1, math.ceil(addresses.count() / (most * 0.9)))  # rows are dealt out evenly, but for a few
    head, ns = '<?xml version="1.0" encoding="UTF-8"?>', "http://www.sitemaps.org/schemas/sitemap/0.9"
    _enclosed(addresses.repartition(files), "xml", f'{head}<urlset xmlns="{ns}">', "</urlset>", "").write.mode("overwrite").text(path)
    out = store.Files(addresses.sparkSession, path)
    names = "".join(f"<sitemap><loc>{escape(n)}</loc></sitemap>" for n in out.names() if n.startswith("part-"))
    out.write("sitemap-index.xml", f'{head}<sitemapindex xmlns="{ns}">{names}</sitemapindex>')
