"""Sentence units of texts in many languages and scripts: the best split of each paragraph into whole spans.

Blank lines and list items cut a text into pieces. In a piece, every mark that may end a sentence is a candidate, and
for scripts that write none, every space between their letters. A semi-Markov dynamic programme then chooses whole
spans between candidates: a span's score joins its closing word (an abbreviation or not), the opening word after it,
its length, and whether it begins or ends inside a pair of quotation marks or brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.tables import spread

# Abbreviations after which a sentence goes on whatever follows (titles, pointers, quantities).
NEVER = frozenset(
    # English
    "dr ph mr mrs ms prof sen rep gov gen col lt sgt capt hon rev messrs st mt ft no nos p pp vol ch fig figs sec secs art par para cf vs v approx est ca incl excl esp e.g i.e viz al dept exec asst assoc misc min max avg sq cu "
    # German
    "hr fr fa nr abs abb kap vgl bzw ggf ggü rd evtl inkl exkl zzgl gem lt u.a z.b d.h o.ä u.u i.d.r z.t s tel str mio mrd tsd med phil jur rer nat dipl ing mag bd hrsg sog "
    # French
    "m mm mme mmes mlle me env éd chap réf n.b p.ex c.-à-d "
    # Spanish
    "sr sra sres srta dra lic arq d dña núm nº pág págs aprox mill ud uds p.ej ee "
    # Russian
    "г-н г-жа проф акад стр рис табл гл п пп ст см ср т.е т.к им ул д кв обл напр тыс ок "
    # Arabic and Hindi
    "د أ م ص डॉ श्री श्रीमती पं प्रो कु".split()
)
# Abbreviations that may end a sentence; what follows decides.
MAYBE = frozenset(
    "janv févr avr juil déc ene abr dic inc ltd llc plc co corp bros gmbh ag kg sa s.a cie cía etc usw ff f a.m p.m p.a u.s u.k e.u u.n u.s.a d.c yr yrs mo hrs hr jr sr ph.d jan feb mar apr jun jul aug sept sep oct nov dec "
    "uu г гг руб долл коп т.д т.п др сент окт нояб дек янв февр авг млн млрд stk min sec km kg lb oz ft in".split()
)
MONTHS = frozenset("janv févr avr juil déc ene abr dic jan feb mar apr jun jul aug sept sep oct nov dec january february march april may june july august september october november december januar februar märz april mai juni juli august september oktober november dezember".split())
# German nouns that an ordinal number with a point precedes.
_COUNTED = frozenset("Quartal Halbjahr Jahr Jahrhundert Tag Woche Monat Stock Etage Platz Mal Kapitel Abschnitt Runde Auflage".split())
_CORPORATE = frozenset("partners holdings ltd inc kg ohg llc plc corp co gmbh ag & sa spa bros".split())
# Words that go on after a closed quotation in Chinese, Japanese and Korean.
_GOES_ON = regex.compile(
    r"\s*(?:[,，、;；:：)）\]—–]|-\s|[とはがをにのもで](?!\p{Latin}*概)|って|라고|이라고|라는|고\s|하고|은\s|는\s"
    r"|\s+(?:(?:Dr|Mr|Ms|Mrs|Prof|Sen|Gen|Rep)\.\s+)?\p{Lu}[\p{L}.’'-]*(?:\s+\p{Lu}[\p{L}.’'-]*){0,3}\s+(?:asked|said|replied|added|wrote|noted|says|told|argued|warned|recalled|explained)\b(?!\s*:)"
    r"|(?:[\p{Latin} .’'-]{1,40}|[\p{Han}]{0,6}(?:人|者|方|员|层|会|司))(?:说|问道|表示|称|指出|补充说?|强调|回答|写道|解释)(?:道)?[。，！,.])"
)
_ZH_ON = regex.compile(r"\s*(?:但|却|而|并|不过|然而|可是|只是)")
_ABBREVIATED = NEVER | MAYBE
OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "[": "]", "【": "】", "‹": "›", "〈": "〉"}
CLOSE = {"”", "“", "»", "」", "』", "》", "）", ")", "]", "】", "›", "〉", '"', "’", "'"}
_MARKS = ".!?…。！？．｡।॥؟۔‼⁇⁈⁉"
_STRONG = "。！？．｡।॥؟۔"
_CLUSTER = regex.compile(rf"[{_MARKS}]+(?:[\x20  ]?»|[”“」』》）)\]】›〉\"’'])*(?:[{_MARKS}]+[”“»」』》）)\]】›〉\"’']*)*")
_REFS = re.compile(r"(?:[ \t 　]*\n?[ \t 　]*\[C[A-Z]\d+\])+")
#: how a piece of sentences ends; one that doesn't is a heading, where an abbreviation hardly ends a unit
_CLOSED = regex.compile(rf"[{_MARKS}][\x20\u00a0\u202f]?[”“»」』》）)\]】›〉\"’']*(?:\s*\[C[A-Z]\d+\])*\s*$")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_ITEM = re.compile(r"[^\S\n\r]*(?:[-•*‣◦●▪][^\S\n\r]+)")
_NO_SPACES = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_TOKEN = regex.compile(r"(?:[\p{L}\p{M}\p{N}]+(?:[.\-–’'&][\p{L}\p{M}\p{N}]+)*|[\p{L}\p{M}\p{N}]+)$")
_NEXT = regex.compile(r"[\s\"“”„«»‹›‘’'(（\[「『《¿¡—–-]*")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: the score of an end that hardly can be one; what a span loses for each of its ends inside a pair of marks; what one loses for being very short, and for each character beyond a long sentence
HARDLY, TORN, SHORT, LONG = -9.0, 7.0, 2.0, 0.002
SHORTEST, LONGEST = 4, 240


#: what may stand before a full stop that no space follows: a word or number that is no part of an address or path
_JOINED = regex.compile(r"(?:^|[\s(“„«])[^\s/\\\\@]*[\p{Ll}\p{Lo}\p{M}\p{N}%)\]]$")


_PAIR = regex.compile(r"(?<![\p{L}.])(\p{L}{1,2})\.\s*(\p{L}{1,2})$")
_LAST = regex.compile(r".*(?:\p{Ll}{2}|\p{N})\.(\p{Lu}\p{L}*)")
_APOSTROPHE = re.compile("[’']")
_SPLIT = re.compile(r"[^\w.\-–’'&\u0300-\u036f\u0900-\u0dff\u064b-\u0652]+")


def closing_token(text: str, at: int) -> str:
    """The word before the mark at ``at``; two letters with points are one word where that is an abbreviation (z. B., S. A.)."""
    left = text[max(0, at - 30) : at]
    if (m := _PAIR.search(left, max(0, len(left) - 8))) and (pair := f"{m[1]}.{m[2]}".lower()) in _ABBREVIATED:
        return pair
    m = _TOKEN.search(_SPLIT.split(left)[-1])
    token = _APOSTROPHE.split(m[0])[-1] if m else ""
    if "." in token and (k := _LAST.fullmatch(token)) is not None:
        return k[1]
    if (k := token.rpartition(".")[2]) != token and len(k) > 1 and k[0].isupper() and k.lower() in NEVER:
        return k
    return token


_CAMEL = re.compile(r"[a-z]{1,3}[A-Z0-9]")
_AFTER_JOIN = regex.compile(r"\p{Lu}[\p{Ll}’'-]|\p{Lu}\. |\p{Lu}\s|\p{Lo}|[a-z]{1,3}[A-Z0-9]")
_QUOTE_NEXT = regex.compile(r"[“„«「(（]")
_YEAR = regex.compile(r"\p{N}\s*г$")
_UPPER_DOTS, _LOWER_DOTS = regex.compile(r"(?:\p{Lu}\.)+\p{Lu}"), regex.compile(r"(?:\p{Ll}\.)+\p{Ll}")


def mark_score(text: str, start: int, at: int, closed: int, end: int, stop: int) -> float:
    """How well a sentence ends at ``end``. Its marks stand from ``at`` to ``closed``, references after.

    ``start`` and ``stop`` bound the piece. The score is a log-odds by hand: above 0 a boundary is likely. The plain
    cases, most full stops of numbers, words and addresses, are told first.
    """
    marks = text[at:closed]
    if end >= stop:
        return 6.0
    if marks == "." and closed == end and end + 1 < stop:
        c = text[end]
        if c in "0123456789,;:，；：、%" or "a" <= c <= "z" and not _CAMEL.match(text, end):
            return HARDLY
        if c == " ":
            c = text[end + 1]
            if c.isupper():
                word = text[text.rfind(" ", max(start, at - 30), at) + 1 : at]
                if 2 < len(word) < 30 and word.isalpha() and word.lower() not in _ABBREVIATED:
                    return 4.0
            elif c.islower() and not _CAMEL.match(text, end + 1):
                return -6.0
    elif marks == "。":
        return HARDLY if text[end] in ",;:，；：、%" else 5.0
    m = _NEXT.match(text, end, stop)
    gap, nxt = m[0], m.end()
    head = text[nxt] if nxt < stop else ""
    word = _WORD.match(text, nxt, stop)
    word = word[0] if word else ""
    spaced = gap[:1].isspace() or end < stop and text[end].isspace()
    inner = any(c in CLOSE for c in marks)
    strong = any(c in _STRONG for c in marks)
    cjk_next = bool(_CJK.match(head)) if head else False
    lower = head.islower() and not _CAMEL.match(word)
    if inner and _GOES_ON.match(text, end, stop) and (marks[-1] not in ")）]" or text[end] in ",;:，、；："):
        return HARDLY
    if not spaced and head and gap[:1] in (",", ";", ":"):
        return HARDLY
    if text[end : end + 1] in ",;:，；：、%":
        return HARDLY
    if strong:
        if lower and not cjk_next and marks[0] in "؟۔।॥":
            return -3.0
        return 5.0
    if "…" in marks and marks.strip("…\"”’»") == "" or set(marks) <= {"."} and len(marks) >= 3:
        if _ZH_ON.match(text, end, stop) or lower:
            return -4.0
        return 2.5 if spaced or cjk_next or not head.isascii() or head.isupper() or _CAMEL.match(word) or _CJK.search(text[max(start, at - 12) : at]) else HARDLY
    if "!" in marks or "?" in marks:
        if not spaced and not cjk_next and not gap and (lower or head.isdigit()) and not inner:
            return HARDLY
        return -5.0 if lower else 4.0
    raw = closing_token(text, at)
    token = raw.lower()
    if not spaced:
        if cjk_next:
            if text[nxt] in "はがをにのもでと" or token in NEVER:
                return HARDLY
            return 3.5 if len(token) > 1 or inner or text[at - 1] in "%)]" else HARDLY
        if not gap and not inner and head and not head.isdigit() and not lower and (token in MAYBE or _JOINED.search(text, max(start, at - 40), at)) and _AFTER_JOIN.match(text, nxt):
            return 3.0 if token not in NEVER and token not in MAYBE else 2.0 if token not in NEVER else -1.0
        if gap and not inner and head and _QUOTE_NEXT.match(gap) and len(token) > 2:
            return 3.0
        if inner and head and _CJK.search(text[start:stop]):
            return 3.0
        return HARDLY
    if inner and not lower:
        return 3.5
    if lower:
        return -6.0
    if token == "г" and _YEAR.search(text[max(start, at - 8) : at]):
        return 2.0
    if token in NEVER or len(token) == 1 and text[at - 1].islower():
        return -8.0
    if len(token) == 1 and token.isalpha() or _UPPER_DOTS.fullmatch(raw) and token not in MAYBE:
        return -6.0 if word[:1].isupper() and not (_NEXT_IS_OPENER(word) and len(word) > 1) else -2.0
    if _LOWER_DOTS.fullmatch(raw) and token not in MAYBE:
        return -3.0
    if token in MAYBE or token.rpartition(".")[2] in MAYBE and "." in token:
        if head.isdigit():
            return -5.0 if token in MONTHS else 1.0
        if word.lower() in _CORPORATE:
            return -6.0
        return 1.5
    if token.isdigit():
        if len(token) <= 2 and (word.lower() in MONTHS or word in _COUNTED):
            return -8.0
        if not text[start : at - len(token)].strip():
            return -6.0
    if head.isdigit() or head.isupper() or _CAMEL.match(word):
        return 4.0
    return 4.0 if head else 3.0


_OPENERS = frozenset("the a an this that these those it its he she they we our in on at for from by with as if when while after before since no not but and or analysts management investors one who what does is are interviews".split())


def _NEXT_IS_OPENER(word: str) -> bool:
    return word.lower() in _OPENERS


def pieces(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the stretches between blank lines and list items; ``whole`` ones are one unit."""
    start, at, item = None, 0, False
    bounds = [m.span() for m in _LINE.finditer(text)] + [(len(text), len(text))]
    for lo, hi in bounds:
        if not text[at:lo].strip():
            if start is not None:
                yield start, at, item
            start, item = None, False
        elif _ITEM.match(text, at, lo):
            if start is not None:
                yield start, at, item
            start, item = at, True
        elif start is None:
            start, item = at, False
        at = hi
    if start is not None:
        yield start, len(text), item


def candidates(text: str, start: int, stop: int, spaceless: bool = True) -> list[tuple[int, float]]:
    """(end, score) of the places in a piece where a unit may end; the last is the piece's end."""
    out = {}
    heading = None
    for m in _CLUSTER.finditer(text, start, stop):
        closed = m.end()
        if closed - m.start() > 1 and (k := m[0].find("“")) > 0 and text.rfind("„", start, m.start()) <= text.rfind("“", start, m.start()):
            closed = m.start() + k  # it opens a quotation
        end = closed
        if end < stop and text[end] in "[ \n\t\xa0\u3000" and (r := _REFS.match(text, end, stop)) is not None:
            if text[r.end() : r.end() + 1] in tuple(_MARKS + ",;:、，"):
                continue
            end = r.end()
        s = mark_score(text, start, m.start(), closed, end, stop)
        if 0 < s <= 2.0:
            if heading is None:
                heading = not _CLOSED.search(text, start, stop)
            s -= 3.0 * heading
        out[end] = s
    if spaceless and _NO_SPACES.search(text, start, stop):
        for m in re.compile(r"\s+").finditer(text, start, stop):
            a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if _NO_SPACES.match(a) and b and (_NO_SPACES.match(b) or b.isupper() or b in "“\"("):
                out[m.start()] = max(out.get(m.start(), HARDLY), 3.0 if _NO_SPACES.match(b) else 1.5)
    return [x for x in sorted(out.items()) if x[0] < stop and not text[x[0] : stop].isspace()] + [(stop, 6.0)]


_BRACKET = re.compile("[" + "".join("\\" + c for c in {*OPEN, *CLOSE} - {"’", "'"}) + "]")


def pairs(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(after the opening mark, before the closing one) of the quotations and brackets of a piece that are both opened and closed in it."""
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()  # closing marks of the stack
    out = []
    for m in _BRACKET.finditer(text, start, stop):
        c = m[0]
        inner = bool(stack) and stack[-1][0] == c
        if c in CLOSE and awaited[c] and (inner or c not in OPEN and c != '"'):  # a mark that also opens closes only the innermost pair
            while True:
                mark, begin = stack.pop()
                awaited[mark] -= 1
                if mark == c:
                    break
            out.append((begin, m.start()))
        elif c in OPEN or c == '"':
            stack.append((OPEN.get(c, c), m.end()))
            awaited[stack[-1][0]] += 1
    return out


def split_piece(text: str, start: int, stop: int, spaceless: bool = True, marked: bool = True) -> list[tuple[int, int]]:
    """The best spans of one piece: those with the largest sum of scores.

    A span's score is that of its end, less what it loses for its length and for each end inside a pair of marks. The
    search is exact without trying every span: an end whose worth is below what a cut can save in length is in no best
    split, and no best span reaches over an end of positive worth that would leave two spans of sound length.
    """
    ends = candidates(text, start, stop, spaceless)
    if len(ends) == 1:
        return [(start, stop)]
    torn = set()
    if marked:
        cuts = [e for e, _ in ends]
        for a, b in pairs(text, start, stop):
            torn.update(cuts[bisect_left(cuts, a) : bisect_right(cuts, b)])
    worth = [(e, s - 2 * TORN * (e in torn)) for e, s in ends[:-1]]
    kept = [x for x in worth if x[1] >= -LONG * LONGEST - 1e-9]
    cuts, gain = [start, *[e for e, _ in kept], stop], [0.0, *[s for _, s in kept], 0.0]
    n = len(cuts) - 1
    best, back = [0.0] + [0.0] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        top, at, end = float("-inf"), 0, cuts[j]
        near = None  # the nearest end of positive worth that lies a sound length before this one
        for i in range(j - 1, -1, -1):
            size = end - cuts[i]
            score = best[i] - SHORT * (size < SHORTEST) - LONG * max(0, size - LONGEST)
            if score >= top:  # of equal splits the one with longer spans
                top, at = score, i
            if near is not None and near - cuts[i] >= SHORTEST:
                break
            if near is None and gain[i] > 0 and size >= SHORTEST:
                near = cuts[i]
        best[j], back[j] = top + gain[j], at
    out, j = [], n
    while j:
        out.append((cuts[back[j]], cuts[j]))
        j = back[j]
    return out[::-1]


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, from its first to its last non-blank character; none for blank texts."""
    out = []
    if text:
        spaceless, marked = _NO_SPACES.search(text) is not None, _BRACKET.search(text) is not None
        for lo, hi, whole in pieces(text):
            for a, b in [(lo, hi)] if whole else split_piece(text, lo, hi, spaceless, marked):
                part = text[a:b]
                left = len(part) - len(part.lstrip())
                if left < len(part):
                    out.append((a + left, a + len(part.rstrip())))
    return out


def sentences(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, sent_start, sent_end), one for each sentence unit of each row of ``df``.

    Null, empty and blank texts give nothing, an empty table no rows. Rows are independent: repeated rows give repeated
    units, and nothing is shuffled but a table too small to give each core a split. Other columns are ignored, whatever their names.
    """
    src = spread(df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sub = b.slice(lo, 256)
                at, first, last = [], [], []
                for i, t in enumerate(sub.column(1).to_pylist()):
                    for s, e in sentence_units(t):
                        at.append(i)
                        first.append(s)
                        last.append(e)
                yield pa.RecordBatch.from_arrays([sub.column(0).take(pa.array(at, pa.int32())), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc", "sent_start", "sent_end"])

    return src.mapInArrow(run, f"doc {dict(src.dtypes)['doc']}, sent_start long, sent_end long").withColumnRenamed("doc", doc)
