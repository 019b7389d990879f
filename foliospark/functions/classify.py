"""Sector texts to buckets (several each) and focus tags, by rule tables that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import title_case
from foliospark.tables import strip

# Bucket labels and the patterns that put a sector into them, case-insensitive.
BUCKETS = {
    "AI": [r"\bai\b", "artificial intelligence"],
    "Enterprise software": ["enterprise", r"\bsaas\b", "software", r"\bhcm\b", "payroll", "workforce", "developer tools", "project management", "cybersecurity", "data security", "clinical documentation"],
    "Infrastructure": ["infrastructure", "platform", "silicon photonics", "onsite power", "payments infrastructure"],
    "Energy & climate": ["energy", "climate", "grid batteries", "power generation"],
    "Data & security": ["data infrastructure", "data security", "cybersecurity"],
    "Edtech": ["edtech", "language learning", "language training"],
    "Fintech": ["payments", "financial software", "finance software"],
    "Healthcare": ["healthcare", "clinical"],
    "Industrial & robotics": ["industrial", "robotics", "critical infrastructure"],
    "Semiconductors": ["semiconductor", "silicon photonics"],
    "Search": ["search"],
    "Workforce": ["workforce", r"\bhcm\b", "payroll"],
    "Developer tools": ["developer tools", "project management"],
}
# Focus tags of sector parts.
FOCUS_TAGS = {
    "ai": "AI", "artificial intelligence": "AI", "frontier ai": "Frontier AI", "generative ai": "Generative AI", "enterprise generative ai": "Enterprise genAI", "ai infrastructure": "AI infrastructure",
    "ai platform": "AI platform", "enterprise ai saas": "Enterprise AI SaaS", "ai video generation": "AI video", "ai language learning": "AI language", "consumer subscription edtech": "Consumer edtech",
    "enterprise language training": "Enterprise training", "language learning marketplace": "Language marketplace", "data infrastructure": "Data infrastructure", "long-duration energy storage": "Energy storage",
    "grid batteries": "Grid batteries", "onsite power generation": "Onsite power", "enterprise energy management": "Energy management", "payments infrastructure": "Payments infra", "financial software": "Financial software",
    "finance software": "Finance software", "data security": "Data security", "enterprise cybersecurity": "Cybersecurity", "clinical documentation": "Clinical documentation",
    "critical infrastructure": "Critical infrastructure", "silicon photonics": "Silicon photonics", "developer tools": "Developer tools", "project management software": "Project management",
}


def _java(pattern: str) -> str:
    """Word borders as ASCII ones: the JVM's own take accented letters for letters."""
    if pattern.startswith(r"\b"):
        pattern = r"(?<![A-Za-z0-9_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?![A-Za-z0-9_])"
    return pattern


def buckets(sector: Column, rules: dict[str, list[str]] | None = None, other: str = "Other") -> Column:
    """B1: the labels of all rules that a text matches, in the rules' order; the default label if none, or for null."""
    rules = BUCKETS if rules is None else rules
    text = F.coalesce(sector, F.lit(other))
    hits = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + "|".join(map(_java, ps))), label) for label, ps in rules.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(other)))


def focus_tags(sector: Column, tags: dict[str, str] | None = None, other: str = "Other") -> Column:
    """B2: the parts between slashes and ampersands as tags: a fixed one, or the part in title case; each once, first seen first."""
    tags = FOCUS_TAGS if tags is None else tags
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    parts = F.transform(F.split(F.coalesce(sector, F.lit(other)), r"\s*/\s*|\s*&\s*"), lambda p: strip(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.coalesce(table[F.lower(p)], title_case(p))))
