"""Variant spellings of names: a prefix-filtered set-similarity join on token q-grams, verified token by token.

A name becomes the set of the q-grams of its tokens. Two names can share enough q-grams only if the rarer of them do
already, so a name probes the index with its rarest q-grams alone (prefix filter). The candidates that then share
enough are verified: tokens are paired by likeness (typing errors, abbreviations, initials, nicknames, tokens written
together), and a pair counts by how rare its tokens are.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import cut, release

# Letters that decompose to no base letter.
_LETTERS = str.maketrans({"ß": "s", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "a", "œ": "o", "ı": "i"})
# Words that tell nothing of which name is meant.
STOP = frozenset("the of for and und et de la le des du der die das inc ltd llc plc gmbh ag sa co corp company media online group news.com com org net www example".split()) - {"de", "la"}
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame herr frau mme mlle phd mba md msc jr sr esq ceo cto cfo coo ceos founder cofounder".split())
# Given names and the short forms in common use.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "anastasia": "nastya stacy stasia ana", "benjamin": "ben benny benji", "charlotte": "lotte charlie lottie char",
    "dorothea": "dora dot dottie thea", "elizabeth": "liz beth betty eliza lizzie betsy liza", "francisco": "paco fran pancho frank cisco", "gabriela": "gabi gaby gabby",
    "isabella": "bella izzy isa bel", "johannes": "hannes hans jo joh", "katherine": "kate kathy katie kat kit", "leonard": "len leo lenny",
    "margaret": "peggy maggie meg greta marge", "michael": "mike mick mikey misha", "nathaniel": "nate nat nathan", "oluwaseun": "seun olu",
    "patrick": "paddy pat rick", "priyanka": "priya pri", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert",
    "susannah": "sue zanna susie suzy sanna", "theodore": "ted theo teddy", "ulrich": "uli ulli", "victoria": "vicky tori vic vicki",
    "william": "bill will billy willy liam", "xiaomei": "mei xiao", "yevgeny": "zhenya eugene genya jenya", "zachary": "zack zach zac zak",
    "hiroshi": "hiro", "kwame": "kwam", "james": "jim jimmy jamie", "thomas": "tom tommy", "joseph": "joe joey", "edward": "ed eddie ned ted",
    "catherine": "cathy cate", "christopher": "chris kit", "daniel": "dan danny", "matthew": "matt", "anthony": "tony", "samuel": "sam sammy",
    "jennifer": "jen jenny", "rebecca": "becky", "deborah": "deb debbie", "stephen": "steve", "andrew": "andy drew", "nicholas": "nick nico",
}
_GIVEN = {}
for _full, _shorts in NICKNAMES.items():
    for _s in [_full, *_shorts.split()]:
        _GIVEN.setdefault(_s, set()).add(_full)


#: what a short form that names its rarest part counts, whatever it leaves out, so that two readings tie
SHORT_FORM = 0.65


@lru_cache(50_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text).lower().translate(_LETTERS)
    return "".join(c for c in t if not unicodedata.combining(c))


@lru_cache(50_000)
def plain(token: str) -> str:
    """A folded token in which ae, oe, ue and ss count as the letter that they spell."""
    return re.sub("ss", "s", re.sub("(a|o|u)e", r"\1", token))


@lru_cache(50_000)
def organisation_tokens(text: str) -> list[str]:
    t = re.sub(r"\.(?:example|com|org|net|co|io|de|fr)\s*$", "", text.strip(), flags=re.I)
    words = [w for w in re.split(r"[\W_]+", fold(re.sub(r"[’']s?\b", "", t))) if w]
    kept = [w for w in words if w not in STOP]
    return kept or words


@lru_cache(50_000)
def person_tokens(text: str) -> list[str]:
    t = re.sub(r"\([^()]*\)|[“\"„«][^”\"“»]*[”\"“»]", " ", unicodedata.normalize("NFKC", text))
    words = [w for w in re.split(r"[\W_]+", fold(t)) if w]
    return [w for w in words if w not in TITLES] or words


@lru_cache(50_000)
def acronym(text: str) -> str | None:
    """The letters of a name that is written as an acronym: RRTC, K.Q.A.; None for any other."""
    t = unicodedata.normalize("NFKC", text).strip()
    if re.fullmatch(r"(?:[A-ZÀ-Þ]\.? ?){2,8}", t) and t.upper() == t and not (" " in t and "." not in t):
        return fold(re.sub(r"[. ]", "", t))
    return None


@lru_cache(50_000)
def initials(text: str) -> str:
    words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s-]", " ", text)) if w and fold(w) not in STOP | {"and", "of", "for"}]
    return "".join(fold(w[0])[:1] for w in words)


def grams(tokens: Iterable[str], q: int = 3) -> list[str]:
    out = set()
    for t in tokens:
        t = plain(t)
        out.update(t[i : i + q] for i in range(len(t) - q + 1)) if len(t) > q else out.add(t)
    return sorted(out)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions; ``most`` + 1 for anything larger than ``most``. Only cells within ``most`` of the diagonal are looked at."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    far = most + 1
    if abs(n - m) > most:
        return far
    lo, end = 0, min(n, m)
    while lo < end and a[lo] == b[lo]:
        lo += 1
    lo = max(0, lo - 1)  # a transposition may begin with the last equal letter
    a, b = a[lo:], b[lo:]
    n, m = n - lo, m - lo
    two, one = None, [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        x, left, right = a[i - 1], max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        least = far
        for j in range(left, right + 1):
            y = b[j - 1]
            v = one[j - 1] + (x != y)
            if one[j] + 1 < v:
                v = one[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and two[j - 2] + 1 < v:
                v = two[j - 2] + 1
            row[j] = v
            if v < least:
                least = v
        if least > most and row[0] > most:
            return far
        two, one = one, row
    return min(one[m], far)


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(200_000)
def token_likeness(a: str, b: str, persons: bool) -> float:
    """1 for equal tokens, less for nicknames, initials, up to two typing errors, and ``a`` abbreviating ``b``, else 0."""
    if a == b:
        return 1.0
    if plain(a) == plain(b):
        return 0.98
    if not persons and len(a) >= 3 and a[0] == b[0] and len(b) - len(a) >= 2 and (b.startswith(a) or a[-1] in b[len(b) // 2 :] and _within(a, b)):
        return 0.9
    if not persons and len(a) >= 5 and a[0] == b[0] and len(b) - len(a) >= 2 and any(_within(a[:i] + a[i + 1 :], b) for i in range(1, len(a))) and len(set(a) & set(b)) >= 4:
        return 0.8  # an abbreviation with a typing error
    if len(a) > len(b):
        a, b = b, a
    if persons and _GIVEN.get(a, set()) & _GIVEN.get(b, set()):
        return 0.95
    if len(a) == 1:
        return 0.9 if persons and b[0] == a else 0.0
    most = 1 if len(b) < 8 else 2
    if len(b) >= 3 and (d := min(edits(a, b, most), edits(plain(a), plain(b), most))) <= most and d / len(b) <= 0.34:
        return 1 - d / len(b)
    if persons and any(edits(full, long, 1) <= 1 for short, long in ((a, b), (b, a)) if len(long) > 4 and long not in _GIVEN for full in _GIVEN.get(short, ())):
        return 0.85  # a short form and its given name with a typing error
    return 0.0


def soft_likeness(a: list[str], b: list[str], weight: dict[str, float], persons: bool) -> tuple[float, list[str], list[str]]:
    """Weighted share of likely paired tokens of two names, and the tokens of each that found no partner.

    Pairs are chosen greedily from the most alike, those of written-out tokens before initials. A pair has the larger weight of its tokens that are known, so a
    mistyped token doesn't count as a rare one.
    """
    rare = max(weight.values(), default=1.0)
    w = lambda t: 0.3 if len(t) == 1 else weight.get(t, rare)
    pairs = sorted(((s, len(x), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := token_likeness(x, y, persons)) > 0), key=lambda p: (p[1] == 1 or len(b[p[3]]) == 1, -p[0], -p[1], p[2], p[3]))
    used_a, used_b, got, total = set(), set(), 0.0, 0.0
    for s, _, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            both = [weight[t] for t in (a[i], b[j]) if t in weight and len(t) > 1]
            one = max(both) if both else rare if len(a[i]) > 1 and len(b[j]) > 1 else max(w(a[i]), w(b[j])) if persons else 0.3
            got, total = got + 2 * one * s, total + 2 * one
    left_a, left_b = [x for i, x in enumerate(a) if i not in used_a], [y for j, y in enumerate(b) if j not in used_b]
    total += sum(map(w, left_a)) + sum(map(w, left_b))
    return (got / total if total else 0.0), left_a, left_b


def _initials_fit(x: list[str], y: list[str]) -> bool:
    """Whether the first initial of ``x``, where it has one, can be that of a given name which only ``y`` writes out."""
    first = next((t for t in x if len(t) == 1), None)
    if first is None:
        return True
    left = [t for t in y if len(t) > 1]
    for t in x:
        if len(t) > 1 and left and token_likeness(t, best := max(left, key=lambda u: token_likeness(t, u, True)), True) > 0:
            left.remove(best)
    return not left or any(t[0] == first or any(g[0] == first for g in _GIVEN.get(t, ())) for t in left)


def person_likeness(a: str, b: str, weight: dict[str, float]) -> float:
    """How likely two spellings mean one person: 0 where a written-out part of one has no partner in the other."""
    x, y = person_tokens(a), person_tokens(b)
    s, left_x, left_y = soft_likeness(x, y, weight, True)
    if any(len(t) > 1 for t in left_x + left_y) or left_x and left_y:
        flat = edits("".join(sorted(x)), "".join(sorted(y)), 1)
        return 0.9 if flat <= 1 and "".join(x) == "".join(y) else 0.0
    if not any(len(t) > 1 for t in x) or not any(len(t) > 1 for t in y):
        return 0.0
    return s if _initials_fit(x, y) and _initials_fit(y, x) else 0.0


@lru_cache(50_000)
def flat(text: str) -> str:
    """The letters and digits of a typed name without anything between them."""
    return "".join(w for w in re.split(r"[\W_]+", fold(re.sub(r"\.(?:example|com|org|net)\s*$", "", text.strip(), flags=re.I))) if w)


@lru_cache(50_000)
def flat_forms(text: str) -> tuple[tuple[bool, str], ...]:
    """A listed name written without spaces, with and without its articles and conjunctions; whether ``the`` is left out."""
    words = [w for w in re.split(r"[\W_]+", fold(text.replace("&", " and "))) if w]
    return tuple(dict.fromkeys((("the" in drop), "".join(w for w in words if w not in drop)) for drop in ((), ("the",), ("and",), ("the", "and"))))


def organisation_likeness(a: str, b: str, weight: dict[str, float]) -> float:
    """How likely spelling ``a`` means the listed organisation ``b``.

    Every token of ``a`` needs a partner. Where ``b`` has tokens beyond, ``a`` is a short form, which counts only if all
    its tokens are spelled right and one of them is among the rarest; acronyms and names written without spaces are compared as a whole.
    """
    if (c := acronym(a)) is not None:
        return 0.9 if c == initials(b) else 0.0
    x, y = organisation_tokens(a), organisation_tokens(b)
    s, left_x, left_y = soft_likeness(x, y, weight, False)
    if not left_x and not left_y and s > 0.97:
        return s
    flat_a, best = flat(a), 0.0
    for the, flat_b in flat_forms(b):
        most = 1 if len(flat_b) < 10 else 2
        flat_x = flat_a[3:] if the and flat_a.startswith("the") else flat_a
        if abs(len(flat_x) - len(flat_b)) <= 2 * most and (d := min(edits(flat_x, flat_b, most), edits(plain(flat_x), plain(flat_b), most))) <= most:
            best = max(best, 1 - d / max(1, len(flat_b)))
    if left_x:
        return best
    if left_y:
        written = {plain(t) for t in y}
        named = max((weight.get(t, 0) for t in y if t not in left_y), default=0) if all(plain(u) in written for u in x) else 0
        return max(best, SHORT_FORM if named and named >= max(weight.values(), default=0) * 0.75 else 0.0)
    return max(best, s)


def candidates(left: DataFrame, right: DataFrame, share: float, same: bool) -> DataFrame:
    """Pairs (scope, a, b) of left and right names of one scope that share at least ``share`` of a's q-grams.

    Both frames have (scope, name, grams). A left name probes with its n - ceil(share n) + 1 rarest q-grams of n,
    which miss no such pair; the shared q-grams are then counted exactly. ``same`` marks a self-join: pairs come out
    once, with a < b, if either name shares enough of its own.
    """
    df_count = left.select(F.explode("grams").alias("g")).unionByName(right.select(F.explode("grams").alias("g"))) if not same else left.select(F.explode("grams").alias("g"))
    freq = df_count.groupBy("g").agg(F.count("*").alias("df"))
    probe = left.select("scope", "name", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(freq, "g")
    order = Window.partitionBy("scope", "name").orderBy("df", "g")
    probe = probe.withColumn("at", F.row_number().over(order)).filter(F.expr(f"at <= n - ceil({share} * n) + 1")).select("scope", "g", F.col("name").alias("a"))
    index = right.select("scope", F.explode("grams").alias("g"), F.col("name").alias("b"))
    met = probe.join(index, ["scope", "g"]).select("scope", "a", "b")
    if same:
        met = met.filter("a <> b").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = met.distinct()
    la, rb = left.select("scope", F.col("name").alias("a"), F.col("grams").alias("ga")), right.select("scope", F.col("name").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    least = F.least(F.size("ga"), F.size("gb")) if same else F.size("ga")
    return met.join(la, ["scope", "a"]).join(rb, ["scope", "b"]).filter(shared >= F.ceil(F.lit(share) * least)).select("scope", "a", "b")


def _deletions(token: str) -> set[str]:
    """What is left of a token without as many letters as may be mistyped: two tokens within the allowed edits share one."""
    out = last = {token}
    for _ in range(2 if len(token) > 5 else 1):  # two errors are allowed from 8 letters on, so also 6 letters against 8
        last = {v[:i] + v[i + 1 :] for v in last for i in range(len(v))}
        out = out | last
    return out


def person_keys(name: str) -> list[tuple[str, list[str]]]:
    """(key, marks) for each way in which a written-out token of a name can meet a like one.

    Two spellings can mean one person only if they have a key in common and, where both have further tokens, a mark:
    those tokens' first letters (as many as survive the allowed edits) and given names. Initials have just their letter.
    """
    toks = person_tokens(name)
    given = [{f"~{g}" for g in _GIVEN.get(t, ())} for t in toks]
    marks = [{c for form in (t, plain(t)) for c in form[: 3 if len(form) > 5 else 2]} | g for t, g in zip(toks, given)]
    out = [("=" + "".join(toks), [])]
    for i, t in enumerate(toks):
        if len(t) > 1:
            others = sorted(set().union(*marks[:i], *marks[i + 1 :]))
            out += [(k, others) for k in sorted(_deletions(t) | _deletions(plain(t)) | given[i])]
    return out


def person_candidates(names: DataFrame) -> DataFrame:
    """Pairs (scope, a, b), a < b, that share a key and (but for few more) a mark of ``person_keys``: exact where one written-out token at least meets another one.

    Complements the q-grams, of which an initial shares none with the name that it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, mask(m)) for i, n in enumerate(b.column(1).to_pylist()) for k, m in person_keys(n)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["scope", "name", "key", "marks"])

    held = names.select("scope", "name").repartition(tasks(names)).mapInArrow(run, "scope string, name string, key string, marks long")
    held = held.select(F.xxhash64("scope", "key").alias("h"), F.xxhash64("name").alias("i"), "scope", "name", "marks")  # equal hashes of other keys only make a pair to be verified
    side = lambda x: held.select("h", F.col("i").alias(f"i{x}"), F.col("scope").alias(f"s{x}"), F.col("name").alias(x), F.col("marks").alias(f"m{x}"))
    # a name has many keys, which no estimate of the plan knows: never broadcast
    met = side("a").hint("merge").join(side("b").hint("merge"), "h").filter("(ia < ib or ia = ib and a < b) and ((ma & mb) <> 0 or ma = 0 or mb = 0) and sa = sb")
    return met.select(F.col("sa").alias("scope"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mask(marks: Iterable[str]) -> int:
    """A set of marks as 63 bits: sets with a common mark have a common bit, others seldom; 0 for none."""
    out = 0
    for m in marks:
        out |= 1 << zlib.crc32(m.encode()) % 63
    return out


def tasks(df: DataFrame) -> int:
    """How many tasks Python work on few bytes is spread over: AQE sizes partitions by bytes, not by work."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_grams(names: DataFrame, persons: bool, listed: bool = False) -> DataFrame:
    """(scope, name) with the q-grams of its tokens as 32-bit checksums; an acronym's one gram is # and its letters, which a listed name has too.

    Grams of equal checksums can only make names look more alike to the candidate search, never less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                if persons:
                    out.append(grams(t for t in person_tokens(n)))
                elif (c := acronym(n)) is not None and not listed:
                    out.append(["#" + c])
                else:
                    out.append(grams(organisation_tokens(n)) + (["#" + initials(n)] if listed else []))
            sums = [sorted({zlib.crc32(g.encode()) - 2**31 for g in gs}) for gs in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.list_(pa.int32()))], names=["scope", "name", "grams"])

    return names.select("scope", "name").repartition(tasks(names)).mapInArrow(run, "scope string, name string, grams array<int>")


def token_rows(names: DataFrame, persons: bool) -> DataFrame:
    """(name, token): each token of each name once."""
    split = person_tokens if persons else organisation_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, t) for n in b.column(0).to_pylist() for t in sorted(set(split(n)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["name", "token"])

    return names.select("name").mapInArrow(run, "name string, token string")


@lru_cache(50_000)
def _read_weights(text: str | None) -> dict[str, float]:
    return {t: float(w) for t, w in (x.split("=") for x in text.split(" "))} if text else {}


def scored(pairs: DataFrame, weights: DataFrame, persons: bool, tokens: DataFrame | None = None) -> DataFrame:
    """Adds the likeness of each pair. ``weights`` has (token, weight); a pair gets those of its own tokens by a join.

    ``tokens`` are the ``token_rows`` of at least all names of the pairs, if they are at hand.

    The largest weight of all, that of unknown tokens, is one number; no table of tokens reaches the driver.
    """
    (most,) = [r["m"] for r in weights.agg(F.max("weight").alias("m")).collect()]
    rarest = {} if most is None else {"": most}  # no token is empty
    if tokens is None:
        tokens = token_rows(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), persons)
    held = tokens.join(weights, "token").groupBy("name").agg(F.array_join(F.collect_list(F.concat_ws("=", "token", F.col("weight").cast("string"))), " ").alias("w"))
    side = lambda x: held.select(F.col("name").alias(x), F.col("w").alias(f"w{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = person_likeness if persons else organisation_likeness
        for b in batches:
            s = [like(x, y, {**rarest, **_read_weights(wx), **_read_weights(wy)}) for x, y, wx, wy in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s, pa.float64())], names=["scope", "a", "b", "likeness"])

    weighed = pairs.select("scope", "a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("scope", "a", "b", "wa", "wb")
    return weighed.repartition(tasks(pairs), F.col("scope"), F.col("a")).mapInArrow(run, "scope string, a string, b string, likeness double")


def token_weights(names: DataFrame, persons: bool, tokens: DataFrame | None = None) -> DataFrame:
    """(token, weight) of every token: log(names / names with it) over all names; ``tokens`` are their ``token_rows``, if at hand."""
    total = names.count() or 1
    rows = token_rows(names, persons) if tokens is None else tokens
    return rows.groupBy("token").agg(F.count("*").alias("n")).select("token", (F.log(F.lit(float(total)) / F.col("n")) + 0.1).alias("weight"))


def link_to_list(names: DataFrame, listed: DataFrame, share: float = 0.3, least: float = 0.6, margin: float = 0.02) -> DataFrame:
    """Rows (name, id, likeness): the one listed organisation that each spelling means, if one does.

    ``names`` has (name), ``listed`` (id, name). A spelling counts once however often given; null, blank and exactly
    listed names need no link and give none. Of several listed names as alike as the best within ``margin`` none is
    chosen. Token weights come from the list.
    """
    listed = listed.filter("name is not null").select("id", F.lit("").alias("scope"), "name")
    asked = names.select(F.lit("").alias("scope"), "name").filter(F.col("name").rlike(r"[\p{L}\p{N}]")).distinct().join(listed.select("name"), "name", "left_anti")
    refs = cut(with_grams(listed.select("scope", "name").distinct(), False, listed=True))
    pairs = cut(candidates(cut(with_grams(asked, False)), refs, share, same=False))
    w = cut(token_weights(listed.select("name").distinct(), False))
    likest = Window.partitionBy("a").orderBy(F.desc("likeness"), "b")
    two = scored(pairs, w, False).filter(F.col("likeness") >= least).withColumn("at", F.row_number().over(likest)).filter("at <= 2")
    best = two.groupBy("a").agg(F.min_by("b", "at").alias("name"), F.max("likeness").alias("likeness"), F.max(F.when(F.col("at") == 2, F.col("likeness"))).alias("next"))
    best = best.filter(f"next is null or likeness - next > {margin}")
    return best.join(listed.groupBy("name").agg(F.min("id").alias("id")), "name").select(F.col("a").alias("name"), "id", "likeness")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, name, root): connected names get one root, the least of them. Labels jump along labels, so rounds are few."""
    both = edges.select("scope", F.col("a").alias("name"), F.col("b").alias("other")).unionByName(edges.select("scope", F.col("b").alias("name"), F.col("a").alias("other")))
    both = cut(both)
    least = both.groupBy("scope", "name").agg(F.min("other").alias("near"))
    state = cut(nodes.select("scope", "name").join(least, ["scope", "name"], "left").select("scope", "name", F.least("name", F.coalesce("near", "name")).alias("root")))
    while True:
        near = both.join(state.select("scope", F.col("name").alias("other"), "root"), ["scope", "other"]).groupBy("scope", "name").agg(F.min("root").alias("near"))
        moved = state.join(near, ["scope", "name"], "left").select("scope", "name", F.least("root", F.coalesce("near", "root")).alias("next"), "root")
        hop = state.select("scope", F.col("name").alias("next"), F.col("root").alias("beyond"))
        moved = cut(moved.join(hop, ["scope", "next"], "left").select("scope", "name", F.least("next", F.coalesce("beyond", "next")).alias("root"), (F.least("next", F.coalesce("beyond", "next")) != F.col("root")).alias("changed")))
        changed = moved.filter("changed").limit(1).count()
        release(state)
        state = moved
        if not changed:
            return state.select("scope", "name", "root")


def person_groups(names: DataFrame, share: float = 0.35, least: float = 0.78) -> DataFrame:
    """(scope, name, root): the spellings of one scope that mean one person share their root.

    ``names`` has (scope, name); null scopes and null, blank or letterless names give nothing; repeats count once, and
    so do names of the same tokens, whatever their case, marks and titles.
    Spellings with a given name written out are linked first and grouped. One with initials only joins a group if all
    groups that it is like are one, else it stays alone: it can't bridge two persons.
    """
    told = cut(spelled(names.select("scope", "name").filter(F.col("scope").isNotNull() & F.col("name").rlike(r"\p{L}")).distinct()))
    short = cut(told.groupBy("scope", F.col("spelled").alias("name")).agg(F.min("short").alias("short")))
    asked = short.select("scope", "name")
    held = cut(with_grams(asked, True))
    each = asked.select("name").distinct()
    tokens = cut(token_rows(each, True))
    w = cut(token_weights(each, True, tokens))
    pairs = candidates(held, held, share, same=True).unionByName(person_candidates(asked)).distinct()
    links = cut(scored(cut(pairs), w, True, tokens).filter(F.col("likeness") >= least))
    flag = lambda c, out: short.select("scope", F.col("name").alias(c), F.col("short").alias(out))
    marked = links.join(flag("a", "sa"), ["scope", "a"]).join(flag("b", "sb"), ["scope", "b"])
    groups = components(asked, marked.filter("not sa and not sb"))
    cross = marked.filter("sa <> sb").select("scope", F.when(F.col("sa"), F.col("a")).otherwise(F.col("b")).alias("name"), F.when(F.col("sa"), F.col("b")).otherwise(F.col("a")).alias("full"))
    joined = cross.join(groups.select("scope", F.col("name").alias("full"), "root"), ["scope", "full"]).groupBy("scope", "name").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi")
    alone = marked.filter("sa and sb").join(joined.select("scope", F.col("name").alias("a")), ["scope", "a"], "left_anti").join(joined.select("scope", F.col("name").alias("b")), ["scope", "b"], "left_anti")
    loose = components(short.filter("short").select("scope", "name"), alone).select("scope", "name", F.col("root").alias("loose"))
    rooted = groups.join(joined.select("scope", "name", "lo"), ["scope", "name"], "left").join(loose, ["scope", "name"], "left").select("scope", F.col("name").alias("spelled"), F.coalesce("lo", "loose", "root").alias("root"))
    return told.join(rooted, ["scope", "spelled"]).select("scope", "name", "root")


_PARTICLES = frozenset("van von de la der den di da del dos".split())


def is_short(name: str) -> bool:
    """Whether a person's name has initials in place of a given name."""
    words = [w for w in re.split(r"[^\w-]+", fold(re.sub(r"\([^()]*\)|[“\"„«][^”\"“»]*[”\"“»]", " ", name))) if w and w not in TITLES | _PARTICLES]
    return any(len(w) == 1 for w in words) and sum(len(w) > 1 for w in words) < 2


def spelled(names: DataFrame) -> DataFrame:
    """(scope, name, spelled, short): names of equal tokens in equal order are one spelling; ``short`` as in ``is_short``.

    A name without tokens is its own spelling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(1).to_pylist()
            forms = [" ".join(person_tokens(n)) or n for n in given]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array([is_short(n) for n in given], pa.bool_())], names=["scope", "name", "spelled", "short"])

    return names.select("scope", "name").mapInArrow(run, "scope string, name string, spelled string, short boolean")
