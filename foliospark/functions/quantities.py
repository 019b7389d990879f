"""What a stated quantity says: its number, its scale, and its unit or currency, from up to three text fields."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple


class Quantity(NamedTuple):
    number: Decimal  #: as written
    factor: Decimal | None  #: what it is multiplied by to come to std_unit, for money before conversion to USD
    std_unit: str | None
    currency: str | None


# Powers of ten by the words and marks that state them.
_SCALES = [
    (r"十亿", 10**9), (r"百万", 10**6), (r"亿|億", 10**8), (r"万|萬", 10**4), (r"千", 10**3),
    (r"trillions?|tn|bio\.?(?= )", 10**12),
    (r"billions?|bn|mrd\.?|mds?|milliards?|mil millones", 10**9),
    (r"millions?|millionen|millones|mln|mn|mio\.?|mill\.|mm", 10**6),
    (r"thousands?|tsd\.?|tausend|milliers?|miles|'000s?|000s|ths", 10**3),
    (r"crores?|cr\.?", 10**7), (r"lakhs?|lacs?", 10**5),
]
# Currencies by their signs, codes and names.
_CURRENCIES = [
    ("CNY", r"CN¥|CNY|RMB|人民币|(?<![美欧日])元|yuan|renminbi"), ("JPY", r"JPY|JP¥|円|yen"), ("USD", r"US\$|USD|\$|dollars?|美元"), ("EUR", r"EUR|€|euros?|欧元"),
    ("GBP", r"GBP|£|pounds sterling"), ("INR", r"INR|₹|Rs\.?|rupees?"), ("KRW", r"KRW|₩|won"),
]
# Physical units and rates by name, with the factor to the common unit.
_UNITS = [
    ("kWh", r"TWh|terawatt[- ]hours?", "1000000000"), ("kWh", r"GWh|gigawatt[- ]hours?", "1000000"), ("kWh", r"MWh|megawatt[- ]hours?", "1000"), ("kWh", r"kWh|kilowatt[- ]hours?", "1"), ("kWh", r"Wh|watt[- ]hours?", "0.001"),
    ("kW", r"TW|terawatts?", "1000000000"), ("kW", r"GW|gigawatts?", "1000000"), ("kW", r"MW|megawatts?", "1000"), ("kW", r"kW|kilowatts?", "1"), ("kW", r"W|watts?", "0.001"),
    ("m2", r"sq\.? ?ft\.?|square (?:feet|foot)|ft2|sqft", "0.09290304"), ("m2", r"hectares?|ha", "10000"), ("m2", r"km2|sq\.? ?km|square kilomet(?:re|er)s?", "1000000"), ("m2", r"sq\.? ?m|sqm|m2|square met(?:re|er)s?|qm", "1"),
    ("kg", r"kt|kilotonn?e?s?", "1000000"), ("kg", r"metric tons?|tonnes?|Tonnen|t", "1000"), ("kg", r"kg|kilograms?|kilos?", "1"), ("kg", r"lbs?\.?|pounds?", "0.45359237"), ("kg", r"g|grams?", "0.001"),
    ("bp", r"bps?|basis points?", "1"), ("bp", r"%|pct|per ?cent|percentages?|Prozent", "100"), ("bp", r"ratio|fraction|share of (?:1|one)|decimals?", "10000"),
]
_COUNTED = re.compile(
    r"\b(?:count|headcount|employees?|staff|people|persons?|personnes?|salari[ée]s?|mitarbeiter|users?|utilisateurs?|nutzer|customers?|clients?|kunden|merchants?|patients?|vehicles?|stores?|shops?|sites?|countries|offices?|"
    r"members?|subscribers?|orders?|units|downloads?|partners?|sellers?|drivers?|students?)\b|人|名|家|辆|台|位",
    re.I,
)
_NUM = re.compile(r"(?<![A-Za-z\d])\d+(?:[.,' ]\d+)*")
_EDGE_L, _EDGE_R = r"(?<![A-Za-z])", r"(?![A-Za-z])"
_SCALE_RE = [(re.compile(p if re.match("[十百亿万千]", p) else rf"{_EDGE_L}(?:{p}){_EDGE_R}", re.I), Decimal(v)) for p, v in _SCALES]
_CUR_RE = [(c, re.compile("|".join(p if not re.match("[A-Za-z]", p) else _EDGE_L + p + ("" if p.endswith("$") or p.endswith("¥") else r"(?![a-zA-Z])") for p in ps.split("|")), re.I)) for c, ps in _CURRENCIES]
_UNIT_RE = [(u, re.compile(rf"{_EDGE_L}(?:{p}){_EDGE_R}", re.I if len(p) > 3 else 0), Decimal(f)) for u, p, f in _UNITS]
_LETTER_SCALE = [(re.compile(p), Decimal(v)) for p, v in ((r"^\s?(?:k|K)(?![A-Za-z])", 10**3), (r"^\s?(?:M|m)(?![A-Za-z\d])", 10**6), (r"^\s?(?:B|b)(?![A-Za-z])", 10**9), (r"^\s?T(?![A-Za-z])", 10**12))]
# in a unit, a currency may carry its scale without a space: USDm, US$bn, €M, EURM
_GLUED = re.compile(r"(USD|US\$|\$|EUR|€|GBP|£|INR|₹|JPY|CNY|RMB|KRW|₩)\s?(mn|mm|m|bn|b|k|tn)\+?(?![A-Za-z])", re.I)
_GLUED_SCALE = {"k": 10**3, "m": 10**6, "mn": 10**6, "mm": 10**6, "b": 10**9, "bn": 10**9, "tn": 10**12}
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_RANGE = re.compile(r"\d\s*(?:[A-Za-z%]+)?\s*(?:-|–|—|~|to|bis|à|至|到)\s*(?:US)?[$€£₹₩]?\s*\d", re.I)


def fold(text: str | None) -> str:
    """One kind of white space, compatibility forms composed; an empty text for null."""
    return " ".join(unicodedata.normalize("NFKC", text).split()) if text else ""


def number(text: str, comma_decimal: bool) -> Decimal:
    """The number that digits with separators write. The last of two kinds of separators is the decimal one."""
    t = text.replace(" ", "").replace("'", "")
    if "," in t and "." in t:
        t = t.replace(",", "") if t.rfind(".") > t.rfind(",") else t.replace(".", "").replace(",", ".")
    elif "," in t:
        grouped = re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+|[1-9]\d?(?:,\d{2})+,\d{3}", t)
        if grouped and not (comma_decimal and t.count(",") == 1):
            t = t.replace(",", "")
        else:
            t = t.replace(",", ".") if t.count(",") == 1 else t.replace(",", "")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    return Decimal(t)


def _unit(text: str) -> tuple[str | None, Decimal | None, str | None, Decimal | None]:
    """(std_unit, unit factor, currency, scale) that a text states; None for what it doesn't."""
    if not text:
        return None, None, None, None
    scale = None
    glued = None
    if m := _GLUED.search(text):
        scale = Decimal(_GLUED_SCALE[m[2].lower()])
        glued = m[1]
    for cur, r in _CUR_RE:
        if r.search(text) or glued and r.search(glued):
            if scale is None:
                scale = next((v for p, v in _SCALE_RE if p.search(text)), None)
            if scale is None and (m := re.search(r"(?<![A-Za-z])(k|K|M|m|B|b)\+?(?![A-Za-z])", text)):
                scale = Decimal(_GLUED_SCALE[m[1].lower()])
            return "USD", Decimal(1), cur, scale
    scale = next((v for p, v in _SCALE_RE if p.search(text)), None)
    for unit, r, f in _UNIT_RE:
        if r.search(text):
            return unit, f, None, scale
    if scale is None and (m := re.match(r"(k|K|M|m|B|b)\s+[A-Za-z]", text)):
        scale = Decimal(_GLUED_SCALE[m[1].lower()])
    if _COUNTED.search(text):
        return "count", Decimal(1), None, scale
    return None, None, None, scale


@lru_cache(100_000)
def _meaning(head: str, pre: str, post: str, u: str) -> tuple[str | None, Decimal | None, str | None, bool]:
    """(std_unit, factor, currency, whether a comma is decimal) that the words around a number state; None for what they don't."""
    std, f, cur, scale = _unit(f"{pre} {post}".strip())
    letter = next((s for p, s in _LETTER_SCALE if p.search(post)), None)
    if letter is not None and std in (None, "USD", "count") and scale is None:
        scale = letter
    told_std, told_f, told_cur, told_scale = _unit(u)
    head_tail = re.search(r"\(([^()]*)\)\s*$|\s(?:in|en)\s+([^()]+)$", head)
    tail = (head_tail[1] or head_tail[2]) if head_tail else ""
    if std is None:
        if told_std is not None:
            std, f, cur = told_std, told_f, told_cur
            scale = told_scale if scale is None else scale
        else:
            std, f, cur, lab_scale = _unit(tail)
            if scale is None:
                scale = told_scale if told_scale is not None else lab_scale
            if std is None and _COUNTED.search(head):
                std, f, cur = "count", Decimal(1), None
    comma_decimal = bool(re.search(r"mio|mrd|milli|mill\.|^\s%", post, re.I))
    if std is None:
        return None, None, None, comma_decimal
    return std, f * (scale if scale is not None else Decimal(1)), cur, comma_decimal


def read_number(label: str | None, value: str | None, unit: str | None) -> Quantity | None:
    """The single number that a value states, with factor and std_unit None where nothing tells its unit; None for no single number.

    None for null, texts without a number, ranges, years and dates. What the value says of scale or unit holds over
    the unit field, and that over the label. Approximation words, bounds and a plus sign change nothing. A bare number
    under a label of counted people or things is a count. What the words around a number mean is read once for all
    numbers in the same words.
    """
    v, u, head = fold(value), fold(unit), fold(label)
    if not v or u.lower() in ("date", "year", "years"):
        return None
    v = re.sub(r"\((?:[^()]*)\)", " ", v).strip()
    v = re.sub(r"\s+(?:in|en|im Jahr|as of|FY)\s*(?:19|20)\d\d$", "", v)
    if _DATE.search(v) or _RANGE.search(v):
        return None
    found = list(_NUM.finditer(v))
    if len(found) != 1:
        return None
    m = found[0]
    pre, post = v[: m.start()], v[m.end() :]
    if re.search(r"(?<!\w)-$", pre.rstrip()):
        return None
    if re.fullmatch(r"(?:19|20)\d\d", v) and re.search(r"founded|year|since|gegründet|成立", head, re.I):
        return None
    std, f, cur, comma_decimal = _meaning(head, pre, post, u)
    try:
        n = number(m[0], comma_decimal)
    except ArithmeticError:
        return None
    return Quantity(n, f, std, cur)


def read_quantity(label: str | None, value: str | None, unit: str | None) -> Quantity | None:
    """The single quantity that the three fields state (see ``read_number``), or None; None also for a number whose unit nothing tells."""
    q = read_number(label, value, unit)
    return None if q is None or q.factor is None else q


_MONEY_NOTE = re.compile(r"amount|money|monetary|valuation|funding|dollar|betr[äa]g|montant|金额|key metrics|USD|EUR|€|\$", re.I)


@lru_cache(10_000)
def read_note(note: str | None) -> dict[str, tuple[Decimal, str | None]]:
    """What a note says of the units of a whole card: money, rate or count to (factor, currency); {} for nothing."""
    t = fold(note)
    if not t:
        return {}
    if re.search(r"percent|\brates?\b|growth|margin|retention|比率|Prozent|taux", t, re.I) and re.search(r"ratio|decimal|fraction|of one|小数", t, re.I):
        return {"rate": (Decimal(10000), None)}
    scale = None
    if re.search(r"unscaled|no scaling|whole|full (?:US )?dollars|plain|not in millions|整", t, re.I):
        scale = Decimal(1)
    if re.search(r"customer|headcount|employee|\bcounts?\b|人数|客户|Mitarbeiter|effectif", t, re.I) and not re.search(r"dollar|USD|EUR|€|\$|美元|monetary", t, re.I):
        s = next((v for p, v in _SCALE_RE if p.search(t)), None)
        return {"count": (s, None)} if s is not None else {}
    cur = next((c for c, r in _CUR_RE if r.search(t)), None)
    if scale is None:
        scale = next((v for p, v in _SCALE_RE if p.search(t)), None)
    if scale is None and (m := re.search(r"(?<![A-Za-z])(k|M|Md|B)\s?[€$£]", t)):
        scale = Decimal({"k": 10**3, "M": 10**6, "Md": 10**9, "B": 10**9}[m[1]])
    if scale is None or cur is None or not _MONEY_NOTE.search(t):
        return {}
    return {"money": (scale, cur)}
