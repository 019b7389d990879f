"""Text functions on columns: claim references, slugs, labels, number formats, paths, markup. All run in the JVM but two."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.tables import BLANK, strip

#: fixed value: an inline claim reference
REF = r"\[(C[A-Z]\d{3})\]"


def tag_slug(x: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends; ``tag`` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("tag"))


def has_refs(x: Column) -> Column:
    """B8."""
    return F.coalesce(x.rlike(REF), F.lit(False))


def refs(x: Column) -> Column:
    """The claim ids of the inline references, in order."""
    return F.regexp_extract_all(x, F.lit(REF), F.lit(1))


def strip_trailing_refs(x: Column) -> Column:
    """A run of references at the very end, with the full stop after it, becomes one full stop."""
    return strip(F.regexp_replace(x, r"(?:\s*\[C[A-Z]\d{3}\])+\.?\z", "."))


def ref_parts(x: Column) -> Column:
    """Array of (kind, value) with kind ``text`` or ``ref`` in order; empty texts are left out, but one part stays."""
    texts, ids = F.split(x, REF, -1), refs(x)
    part = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    pairs = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), ids.alias("r")), lambda p: F.array(part("text", p["t"]), part("ref", p["r"]))))
    kept = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(part("text", F.coalesce(x, F.lit("")))))


def norm(x: Column) -> Column:
    """Lower case without white space around it."""
    return strip(F.lower(x))


def escape_html(x: Column) -> Column:
    """The ampersand first, then the brackets and quotes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def highlight(x: Column, query: str) -> Column:
    """Escaped text with each occurrence of the query, whatever its case, in <mark>. A blank query marks nothing."""
    q = query.strip()
    if not q:
        return escape_html(x)
    literal = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in q)
    return F.regexp_replace(escape_html(x), f"(?i)({literal})", "<mark>$1</mark>")


def callout_class(x: Column) -> Column:
    """A class name of a-z, 0-9 and dashes; ``note`` for a missing type."""
    return F.concat(F.lit("callout-"), F.coalesce(F.nullif(F.regexp_replace(F.lower(x), "[^a-z0-9-]", ""), F.lit("")), F.lit("note")))


def strip_tags(x: Column) -> Column:
    """Text without markup."""
    return strip(F.regexp_replace(x, "<[^>]+>", ""))


def plural(n: Column, one: str, many: str) -> Column:
    """B21."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by a value; unknown names stay, a null value becomes empty."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def locale_path(base: Column, locale: Column, *segments: Column) -> Column:
    """Base, ``zh`` for that locale, and segments joined by single slashes, with one at either end."""
    cut = lambda c: F.nullif(F.regexp_replace(c, r"^/+|/+\z", ""), F.lit(""))
    joined = F.concat_ws("/", *[cut(c) for c in (base, F.when(locale == "zh", "zh").otherwise(""), *segments)])
    return F.when(joined == "", "/").otherwise(F.concat(F.lit("/"), joined, F.lit("/")))


def locale_file(base: Column, locale: Column, name: str) -> Column:
    return F.concat(F.regexp_replace(locale_path(base, locale), r"/\z", ""), F.lit("/" + name))


def title_case(x: Column) -> Column:
    """Each word with a capital first letter, apart from four fixed spellings; words are split at single spaces."""
    word = lambda w: (
        F.when(F.lower(w) == "ai", "AI").when(F.lower(w) == "saas", "SaaS").when(F.lower(w) == "hcm", "HCM").when(F.lower(w) == "it", "IT")
        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    )
    return F.array_join(F.transform(F.split(x, " ", -1), word), " ")


def half_up(x: Column, digits: int) -> Column:
    """A number rounded half away from zero by its shortest decimal form, as decimal."""
    return F.round(x.cast("string").cast("decimal(38,12)"), digits)


def grouped(x: Column, digits: int) -> Column:
    """Thousands in groups, at most ``digits`` decimals, rounded half away from zero."""
    return F.call_function("format_number", half_up(x, digits), F.lit("#,##0" + ("." + "#" * digits if digits else "")))


def month_label(month: Column, zh: bool = False) -> Column:
    """A yyyy-MM month as its locale writes it: January 2024, or year and month with their signs; null for what is no month."""
    day = F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.date_format(day, "yyyy年M月" if zh else "MMMM yyyy")


def money_m(x: Column) -> Column:
    """Millions of dollars as $x.xM, from a thousand on as $x.xB; null for null and non-numbers."""
    ok = x.isNotNull() & ~F.isnan(x)
    return F.when(ok & (F.abs(x) >= 1000), F.concat(F.lit("$"), grouped(x / 1000, 1), F.lit("B"))).when(ok, F.concat(F.lit("$"), grouped(x, 1), F.lit("M")))


def metric(x: Column, suffix: str = "") -> Column:
    """A grouped number with at most three decimals and a suffix."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.concat(grouped(x, 3), F.lit(suffix)))


@F.pandas_udf(StringType())
def to_fixed_1(v: pd.Series) -> pd.Series:
    """One decimal, rounded half up on the exact binary value: 6.35 gives 6.3, 6.25 gives 6.3."""
    return v.map(lambda x: None if x is None or x != x else str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)))


# Labels of enumerated values, English and Chinese.
ENUM_LABELS = {
    "buy": ("Buy", "买入"), "pass": ("Pass", "放弃"), "track": ("Track", "观察"), "avoid": ("Avoid", "回避"), "research-more": ("Research more", "继续研究"),
    "high": ("High", "高"), "medium": ("Medium", "中"), "low": ("Low", "低"), "unknown": ("Unknown", "未知"),
    "stretched": ("Stretched", "偏高"), "fair": ("Fair", "合理"), "expensive": ("Expensive", "昂贵"), "cheap": ("Cheap", "便宜"),
}
# Chinese labels of complete cells.
CELL_LABELS = {"unknown": "未知", "none": "无", "tbd": "待定"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def display_label(x: Column, zh: bool = False) -> Column:
    """A known value's label; in English, camelCase, kebab-case and snake_case in words; any other text as it is."""
    t = strip(x)
    known = _lookup(F.lower(t), {k: v[zh] for k, v in ENUM_LABELS.items()})
    if zh:
        return F.coalesce(known, t, F.lit(""))
    first_up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    camel = F.array_join(F.transform(F.split(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2"), r"\s+"), first_up), " ")
    kebab = F.array_join(F.transform(F.filter(F.split(t, "[-_]+"), lambda w: w != ""), first_up), " ")
    return F.coalesce(
        known,
        F.when(t.rlike(r"^[a-z][A-Za-z0-9]*\z") & t.rlike("[A-Z]"), camel).when(t.rlike(r"^[a-z0-9]+(?:[-_][a-z0-9]+)*\z"), kebab).otherwise(t),
        F.lit(""),
    )


def display_cell(x: Column, zh: bool = True) -> Column:
    """B6."""
    return F.coalesce(_lookup(norm(x), CELL_LABELS), x) if zh else x


def bool_label(x: Column, zh: bool = False) -> Column:
    return F.when(x, "是" if zh else "Yes").when(~x, "否" if zh else "No")


def plain(value) -> str:
    """Any JSON value as text: yes and no, lists joined, an object by its first telling field, else key by key."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "Yes" if value else "No"
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, list):
        return ", ".join(t for t in map(plain, value) if t)
    for names in (("label", "displayValue", "value", "score", "title", "name"), ("detail", "note", "summary")):
        text = plain(next((value[n] for n in names if value.get(n) is not None), None))
        if text.strip():
            return text
    texts = ((k, plain(v)) for k, v in value.items())
    return ", ".join(t for t in (f"{k}: {v}" if v.strip() else k for k, v in texts) if t)


@F.pandas_udf(StringType())
def plain_text(json_text: pd.Series) -> pd.Series:
    """B7 on JSON texts; a text that is no JSON is itself."""
    import json

    def one(t):
        if t is None:
            return ""
        try:
            return plain(json.loads(t))
        except (ValueError, RecursionError):
            return t

    return json_text.map(one)


def host(url: Column) -> Column:
    """V7: the host of a URL, lower case, without www; null where there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.nullif(h, F.lit(""))


def iso_date(x: Column) -> Column:
    """Written dates as yyyy-MM-dd; a month alone as its text; null for what is no date."""
    t = F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+\z", "")
    day = F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "d MMM yyyy"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.when(t.rlike(r"^\d{4}-\d{2}\z"), t).otherwise(F.date_format(day, "yyyy-MM-dd"))
