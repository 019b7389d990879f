"""Encoding a corpus with a public byte-level BPE tokenizer, each shared chunk once.

Texts are cut where a rolling hash of the last 8 characters has its low bits zero, so equal passages give equal chunks
wherever they stand. A chunk that occurs more than once is encoded once, by the first document that has it, and its ids
go to all others; text that no other document shares is encoded where it lies. A cut may fall inside a pre-token, so
every join is repaired: the text from the last certain pre-token border on its left to the first one on its right is
encoded again, and there it agrees with the encodings of both sides, since no merge reaches over a pre-token border.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.tables import cut, spread

TOKENIZERS = "/opt/tokenizers"
#: fixed value: how this vocabulary's encoder splits text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, LEAST, MOST, MASK = 8, 32, 4096, (1 << 6) - 1
#: characters hashed at once; a longer text is hashed alone
HASHED = 1_000_000
#: borders that every pre-tokenizing with PATTERN has, whatever stands around: white space after anything else, and a mark after a letter or number
_CERTAIN = re.compile(r"(?<=\S)[ \n]|(?<=[^\W_])[.,;:!?()\[\]\"“”„«»。，、；：！？（）「」『』《》।؟،]")
#: the fast encoder's splitter can't backtrack over white space without end
_LONG_SPACE = re.compile(r"\s{20000}")
_BASE = 0x9E3779B97F4A7C15
_loaded: dict = {}


def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """The encoding of a vocabulary, text to ids, loaded once per process; texts like its special tokens are plain text."""
    key = f"{folder}/{name}"
    if key not in _loaded:
        import tiktoken

        with open(f"{key}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if len(text) >= 20_000 and _LONG_SPACE.search(text):
                return _other(key)(text)
            return fast(text)

        _loaded[key] = encode
    return _loaded[key]


def _other(key: str) -> Callable[[str], list[int]]:
    """The same vocabulary in an encoder that is slower and takes any white space."""
    name = f"{key}.json"
    if name not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(name)
        t.encode_special_tokens = True
        _loaded[name] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _loaded[name]


def _hash_cuts(text: str) -> np.ndarray:
    """Positions after those windows of a text whose hash has its low bits zero."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h, width, base = codes, 1, np.uint64(_BASE)
        while width < WINDOW:  # two windows side by side are one of twice the width
            h = h[:-width] * base + h[width:]
            width, base = width * 2, base * base
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
        h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(MASK)) == 0) + WINDOW


def _ends(n: int, cuts: Sequence[int]) -> list[int]:
    out, at = [], 0
    for c in cuts:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST and c < n:
            out.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        out.append(at)
    if n:
        out.append(n)
    return out


def chunk_ends(texts: Sequence[str]) -> list[list[int]]:
    """For each text the ends of its content-defined chunks, the last one its length; none for an empty text.

    Chunks have at least 32 characters, except the last, and at most 4,096; the mean is about 96. Texts are hashed
    many at a time; a window that reaches over the start of its text is no cut of it.
    """
    out: list[list[int]] = []
    held: list[str] = []

    def flush():
        cuts, start = _hash_cuts("".join(held)), 0
        stops = np.cumsum([len(t) for t in held])
        at = np.searchsorted(cuts, np.concatenate([[0], stops]), side="right")
        for k, t in enumerate(held):
            out.append(_ends(len(t), (c for c in (cuts[at[k] : at[k + 1]] - start).tolist() if c >= WINDOW)))
            start += len(t)
        held.clear()

    size = 0
    for t in texts:
        if size + len(t) > HASHED and held:
            flush()
            size = 0
        held.append(t)
        size += len(t)
    if held:
        flush()
    return out


def spliced(text: str, known: Sequence[tuple[int, int, Sequence[int]]], encode: Callable[[str], list[int]]) -> list[int]:
    """The ids of a text of which some chunks' own ids are known: ``known`` has (start, end, ids) in order, not overlapping.

    Of a known chunk, what lies between its first and its last certain border is taken; everything else, joins
    included, is encoded from border to border. A chunk without two certain borders is encoded with its neighbours.
    """
    out: list[int] = []
    at = 0
    for a, e, ids in known:
        m = _CERTAIN.search(text, a, e) if a else None
        first = 0 if not a else m.start() if m else e
        last = e if e == len(text) or _CERTAIN.match(text, e) else None
        reach = 32
        while last is None:
            lo = max(first, e - reach)
            last = max((x.start() for x in _CERTAIN.finditer(text, lo, e)), default=None)
            if lo == first:
                break
            reach *= 4
        if last is None or first >= last or first < at:
            continue
        if at < first:
            out += encode(text[at:first])
        head, tail = len(encode(text[a:first])) if first > a else 0, len(encode(text[last:e])) if last < e else 0
        out += ids[head : len(ids) - tail]
        at = last
    return out + encode(text[at:]) if at < len(text) else out


def encode_corpus(df: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (doc, ids): the byte_bpe_50k ids of each text without special tokens.

    Every row of ``df`` gives one row; an empty or null text gives an empty list, and so does a text of a repeated or
    null ``doc``, which is told apart by a row number of its own. Other columns are ignored, whatever their names.

    Only 16-byte digests of the chunks are shuffled to count them, combined before the shuffle. A chunk that very many
    documents share makes a skewed join key with a single row on the other side, which AQE splits. What is collected
    for a row is bounded by the chunks of one document.
    """
    src = spread(df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))).withColumn("row", F.monotonically_increasing_id())
    src_type = dict(src.dtypes)["doc"]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                sub = b.slice(lo, 1024)
                texts = [t or "" for t in sub.column(1).to_pylist()]
                ends = chunk_ends(texts)
                keys = [[hashlib.blake2b(t[a:e].encode(), digest_size=16).digest() for a, e in zip([0, *es], es)] for t, es in zip(texts, ends)]
                yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.binary()))], names=["doc", "text", "row", "ends", "keys"])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(folder)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                texts, ends, spots, names = (b.column(c).slice(lo, 512).to_pylist() for c in ("text", "ends", "spots", "keys"))
                keys, ids = [], []
                for t, es, ps, ks in zip(texts, ends, spots, names):
                    for p, k in zip(ps, ks):
                        keys.append(k)
                        ids.append(encode(t[es[p - 1] if p else 0 : es[p]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(folder)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                sub = b.slice(lo, 512)
                out, weight, begun = [], 0, 0
                for i, (t, es, ps, ids) in enumerate(zip(*(sub.column(c).to_pylist() for c in ("text", "ends", "spots", "ids")))):
                    if ps is None:
                        out.append(encode(t) if t else [])
                    else:
                        out.append(spliced(t, [(es[p - 1] if p else 0, es[p], x) for p, x in zip(ps, ids)], encode))
                    weight += len(out[-1])
                    if weight > 500_000 or i == sub.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([sub.column(0).slice(begun, len(out)), pa.array(out, pa.list_(pa.int32()))], names=["doc", "ids"])
                        out, weight, begun = [], 0, i + 1

    pieces = cut(src.mapInArrow(chunked, f"doc {src_type}, text string, row long, ends array<int>, keys array<binary>"))
    each = pieces.select("row", F.posexplode("keys").alias("pos", "key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("at")).filter("n > 1").select("key", "at.row", "at.pos")
    owners = shared.groupBy("row").agg(F.collect_list(F.struct("pos", "key")).alias("own")).select("row", F.col("own.pos").alias("spots"), F.col("own.key").alias("keys"))
    once = cut(pieces.select("row", "text", "ends").join(owners, "row").mapInArrow(owned, "key binary, ids array<int>"))
    known = each.join(once, "key").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("k")).select("row", F.col("k.pos").alias("spots"), F.col("k.ids").alias("ids"))
    return pieces.drop("keys").join(known, "row", "left").select("doc", "text", "ends", "spots", "ids").mapInArrow(assembled, f"doc {src_type}, ids array<int>").withColumnRenamed("doc", doc)


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (doc, n_tokens) of every row; 0 for an empty or null text. One pass; only a table too small to give each core a split is shuffled."""
    src = spread(df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(folder)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                sub = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array([len(encode(t)) if t else 0 for t in sub.column(1).to_pylist()], pa.int64())], names=["doc", "n_tokens"])

    return src.mapInArrow(run, f"doc {dict(src.dtypes)['doc']}, n_tokens long").withColumnRenamed("doc", doc)
