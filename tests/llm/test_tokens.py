import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import packing, tokens

TEXTS = ["", None, " ", "<|endoftext|> is text", "it's  we'll\n\n  x", "日本語。テスト" * 300, "a" * 20_000, " " * 9_000 + "b", "The board cut retention. " * 400, "🏳️‍🌈𝔘𝔫 " * 500, "\n" * 5_000, "x1y2" * 3_000, " " * 1_000_000 + "a\u3000" * 9, "shared passage, with a mark. " * 9 + "日本語の文。" * 40]


def mixed(rng):
    parts = ["The ", "unit", " cut", "  ", "\n\n", "'s", "n't", "12.5", "日本", "。", "é", "—", "aaaa", " \t", "🚀", "U.S. "]
    return "".join(rng.choice(parts) * rng.randrange(1, 4) for _ in range(rng.randrange(2_000)))


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_plain_encoding(spark):
    rng = random.Random(2)
    texts = TEXTS + [mixed(rng) for _ in range(60)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("row", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert got == dict(enumerate(expected(texts)))
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in tokens.encode_corpus(df).collect()) == [0, 1, 1, 2] and tokens.encode_corpus(df.limit(0)).count() == 0


def test_chunks_are_content_defined():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    each = dict(zip((body, "new start " + body), tokens.chunk_ends([body, "new start " + body])))
    assert each == {t: tokens.chunk_ends(["before", t])[1] for t in each}
    for t, ends in each.items():
        assert ends == sorted(set(ends)) and ends[-1] == len(t) and all(b - a <= tokens.MOST for a, b in zip([0, *ends], ends))
    cut = lambda t: {t[a:b] for a, b in zip([0, *each[t]], each[t])}
    assert len(cut(body) & cut("new start " + body)) >= 0.98 * len(cut(body)) and tokens.chunk_ends(["", "a" * 9_000]) == [[], [4096, 8192, 9000]]


@pytest.mark.parametrize("seed", range(4))
def test_splices_at_any_cut(seed):
    rng, encode = random.Random(seed), tokens.tokenizer()
    for text in [mixed(rng)[:400] for _ in range(60)] + ["   a", "a   ", "\n \n", "it's", "aaaaaaaaaaaa"]:
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randrange(8)))) if len(text) > 1 else []
        known = [(a, b, encode(text[a:b])) for a, b in zip([0, *cuts], [*cuts, len(text)]) if rng.random() < 0.7]
        assert tokens.spliced(text, known, encode) == encode(text)


def test_a_shared_chunk_is_encoded_once_and_used():
    text = "".join(f"Sentence number {i} stands here. " for i in range(200))
    calls, encode = [], tokens.tokenizer()
    got = tokens.spliced(text, [(1000, 5000, encode(text[1000:5000]))], lambda t: calls.append(len(t)) or encode(t))
    assert got == encode(text) and sum(calls) < len(text) - 3_900


def rows(spark, sizes, containers):
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").withColumn("kind", F.lit(1)).withColumn("n", F.lit(2))
    return packing.pack(df, "item", "size", containers).collect()


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    sizes = [min(400, int(rng.paretovariate(1.1) * 5)) for _ in range(3_000)] + [0, None, 7, 7, 7, 100, 101, 250]
    got = rows(spark, sizes, [("a", 100), ("b", 64), ("none", 0), ("null", None)])
    for kind, cap in (("a", 100), ("b", 64)):
        mine = [r for r in got if r.container_kind == kind]
        assert {r.item for r in mine} == set(range(len(sizes)))
        for i, n in enumerate(sizes):
            parts = sorted((r.piece, r.first_unit, r["size"]) for r in mine if r.item == i)
            assert sum(p[2] for p in parts) == (n or 0) and [p[1] for p in parts] == [k * cap for k in range(len(parts))] and (len(parts) == 1 or n > cap)
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
        total = sum(n or 0 for n in sizes)
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill))) and len(fill) <= -(-total // cap) * 1.02 + 1
    assert {r.container_kind for r in got} == {"a", "b"}


def test_packing_edges(spark):
    assert rows(spark, [], [("a", 5)]) == [] and [r.container_id for r in rows(spark, [0, None], [("a", 5)])] == [0, 0]
    assert len({r.container_id for r in rows(spark, [6] * 40, [("a", 10)])}) == 40 and len({r.container_id for r in rows(spark, [5] * 40, [("a", 10)])}) == 20
    assert rows(spark, [3], []) == []


def test_patterns_use_every_length_once():
    rng = random.Random(9)
    for _ in range(50):
        cap = rng.randrange(2, 40)
        hist = {k: rng.randrange(1, 9) for k in rng.sample(range(1, cap + 1), rng.randrange(1, cap))}
        patterns = packing.packing_patterns(hist, cap)
        used = {}
        for count, lengths in patterns:
            assert sum(k * m for k, m in lengths.items()) <= cap
            for k, m in lengths.items():
                used[k] = used.get(k, 0) + count * m
        assert used == hist
