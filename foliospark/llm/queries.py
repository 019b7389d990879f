"""The pN_ queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import names, packing, sentences, tokens
from foliospark.tables import BLANK, cut, last_delivery, read


def p6_publisher_links(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of a publisher's name that means a listed one, with how often it is typed."""
    sources = last_delivery(read(spark, d, "evidence_source").select("source_key", "publisher", "ingested_at", "deleted_at"), ["source_key"]).filter("deleted_at is null")
    typed = cut(sources.groupBy(F.col("publisher").alias("name")).agg(F.count("*").alias("sources")))
    listed = read(spark, d, "publisher_ref").select(F.col("publisher_id").alias("id"), F.col("publisher_name").alias("name"))
    return names.link_to_list(typed, listed).join(typed, "name").select(F.col("name").alias("publisher"), F.col("id").alias("publisher_id"), "likeness", "sources")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Links of every source, also of those deleted since: their publisher's name was typed all the same."""
    sources = last_delivery(read(spark, d, "evidence_source").select("source_key", "publisher", "ingested_at"), ["source_key"])
    listed = read(spark, d, "publisher_ref").select(F.col("publisher_id").alias("id"), F.col("publisher_name").alias("name"))
    links = cut(names.link_to_list(sources.select(F.col("publisher").alias("name")), listed))
    publishers = sources.join(links, sources["publisher"] == links["name"]).select(F.lit("publisher").alias("field"), F.col("id").alias("key_a"), F.col("source_key").alias("key_b"))
    founders = last_delivery(read(spark, d, "founder").select("founder_id", "run_id", "slug", "founder_name", "ingested_at"), ["founder_id"])
    founders = cut(founders.select("founder_id", F.coalesce("slug", F.regexp_extract("run_id", r"^[0-9]{14}-(.+)\z", 1)).alias("scope"), F.col("founder_name").alias("name")))
    known = cut(founders.join(names.person_groups(founders), ["scope", "name"]))
    a, b = (known.select("scope", "root", F.col("founder_id").alias(f"key_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")
    same = a.join(b, ["scope", "root"]).filter("key_a < key_b and name_a <> name_b").select(F.lit("founder").alias("field"), "key_a", "key_b")
    return publishers.unionByName(same)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.token_counts(read(spark, d, "documents")))
    spec = [(r["container_kind"], r["capacity_tokens"]) for r in read(spark, d, "container_spec").collect()]
    return packing.pack(sizes, "doc_id", "n_tokens", spec)


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used of each kind, and the part of their space that is filled."""
    spec = read(spark, d, "container_spec")
    used = _packed(spark, d).groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
    return used.join(spec, "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What packing must keep: of each kind the documents packed, those with a token missing or twice, those cut though they would fit, and the containers over their capacity."""
    spec, sizes = read(spark, d, "container_spec"), cut(tokens.token_counts(read(spark, d, "documents")))
    packed = cut(packing.pack(sizes, "doc_id", "n_tokens", [(r["container_kind"], r["capacity_tokens"]) for r in spec.collect()]))
    whole = packed.groupBy("container_kind", "doc_id").agg(F.sum("size").alias("held"), F.max(F.col("first_unit") + F.col("size")).alias("reach"), F.count("*").alias("parts"))
    docs = whole.join(sizes, "doc_id").join(spec, "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("docs"), F.count_if(F.expr("held <> n_tokens or reach <> n_tokens")).alias("wrong"), F.count_if(F.expr("parts > 1 and n_tokens <= capacity_tokens")).alias("torn")
    )
    over = packed.groupBy("container_kind", "container_id").agg(F.sum("size").alias("held")).join(spec, "container_kind").groupBy("container_kind").agg(F.count_if(F.expr("held > capacity_tokens")).alias("over"))
    return docs.join(over, "container_kind")


def p9_covered(spark: SparkSession, d: str) -> DataFrame:
    """Each document's non-blank characters that lie in its sentence units, which must be all."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    inside = F.expr("substring(text, cast(sent_start + 1 as int), cast(sent_end - sent_start as int))")
    chars = p9_found(spark, d).join(docs, "doc_id").withColumn("n", F.length(F.regexp_replace(inside, f"{BLANK}|[\\x{{180e}}\\x{{200b}}]", "")))
    return chars.groupBy("doc_id").agg(F.sum("n").alias("chars"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(read(spark, d, "documents"))


QUERIES = {"p6_found": p6_found, "p6_publisher_links": p6_publisher_links, "p7_ids": p7_ids, "p8_packing": p8_packing, "p8_fill": p8_fill, "p8_kept": p8_kept, "p9_found": p9_found, "p9_covered": p9_covered}
_SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x{180e}\x{200b}]"
SQL = {
    "p8_kept": "select container_kind, (select count(*) from documents) docs, 0::bigint wrong, 0::bigint torn, 0::bigint as over from container_spec",
    "p9_covered": f"with n as (select doc_id, length(regexp_replace(text, '{_SP}', '', 'g')) chars from documents where text is not null) select doc_id, chars from n where chars > 0",
}
