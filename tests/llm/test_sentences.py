import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm.sentences import sentence_units, sentences

CASES = [
    ["Dr. Benjamin Rebreir joined in Jan. 2024.", "The U.S. and U.K. arms grew 3.5%, i.e. more.", "It was led by Quiogael & Co. Partners."],
    ["“Is it fair?” Robert Gogrim asked.", "“We ship in May. Orders are full,” said Ann.", "Ann wrote: “We ship. Orders are full.”", "(It was not confirmed.)"],
    ["The memo (“We pay. Soon.”) went to all.", "It fell by 9—again!", "Nobody knows…", "One asked why (nobody asked why!) [CR422].", "2024 brought 8 sites. [CO001] [CO002]", "eT494 Labs cut it."],
    ["Am 3. März 2018 wurde z. B. Abs. 2 Nr. 4 der Fa. Giraer verlängert.", "Frau Dr. med. Pioldu meldete im 3. Quartal rd. 833 Aufträge usw.", "„Das gilt. Mehr nicht“, sagte Tude."],
    ["« Rien n’est signé. Nous attendons », a déclaré Mme Velei.", "« La société a publié 57,6 M€. »", "Le contrat (cf. p. 418, art. 5) expire fin 2018, p. ex. ici, etc.", "Quelle surprise ! Le Dr Trioma a fini."][:3],
    ["La planta núm. 4 cuesta aprox. 42,1 mill. de euros.", "¿Quién paga?", "¡El pedido se duplicó!", "La matriz es Xx Yy S. A."],
    ["Завод был построен в 2016 г.", "Г-н Krerso раскрыл 16,8 млрд руб. долга, т. е. до проверки (см. стр. 746).", "«Сделка закрыта. Детали позже», — сообщил источник.", "А. Б. Meti ушёл и т. д."],
    ["قال د. Gioxpu إن العقد ساريا.", "«لا نخشى شيئا. سنواصل العمل»، قال المدير.", "من يمول المصنع؟"],
    ["डॉ. Quinfi ने कहा कि मार्जिन 39.8% है।", "“काम पूरा है। चिंता न करें,” प्रबंधक ने कहा।", "क्या यह सच है?!"],
    ["“납기는 문제없다. 걱정하지 마라.”라고 대표가 말했다.", "대표(익명)는 거부했습니다.", "약 10곳의 매장이 문을 닫았다…"],
]
TIGHT = [
    ["管理层表示：“订单已经排满。我们不会降价。”", "Methnem问：“管理层下调了目标？”", "“能按时交付吗？”一位投资人问道。", "公司（成立于9年。总部未披露）拒绝置评。", "公司下调了v5.7.7版本……但无人证实。", "产能将翻倍。[CO827]", "「尚未确认订单！」", "毛利率约为89.8%。"],
    ["「供給は十分だ。心配は要らない。」と担当者は述べた。", "資料No.9を参照（表2.46）。", "新製品Ver.8.8.7が発売された！", "これは可能か？"],
    ["We couldn't verify the backlog.", "Fendstalt氏は目標を公表した。", "Costs rose 9.9% [CV9].", "取締役会は計画を見直した。"],
]


def units(t):
    return [t[a:b] for a, b in sentence_units(t)]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
@pytest.mark.parametrize("gap", [" ", "  ", "\n", " "])
def test_units_with_spaces(case, gap):
    assert units(gap.join(case)) == case


@pytest.mark.parametrize("case", TIGHT, ids=range(len(TIGHT)))
def test_units_without_spaces(case):
    assert units("".join(case)) == case


@pytest.mark.parametrize("n", [2, 3, 5, 17, 100])
def test_a_quotation_inside_a_sentence_stays_whole_however_long(n):
    said = " ".join(f"Sales of unit {i} grew again." for i in range(n))
    assert units(f"Ann wrote: “{said}” Then she left.") == [f"Ann wrote: “{said}”", "Then she left."]
    assert units(f"The memo (“{said}”) went to all. It is short.") == [f"The memo (“{said}”) went to all.", "It is short."]
    assert units(f"An open (mark. {said} That is all.")[0] == "An open (mark." and len(units(said)) == n


def test_the_search_equals_trying_every_span():
    from foliospark.llm import sentences as s

    rng, parts = random.Random(3), ["Ab cd. ", "x. ", "Dr. ", "“", "” ", "(", ") ", "e.g. ", "Ok! ", "B. ", "lower. word ", "W" * 150 + ". ", "1. "]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))).strip()
        ends = s.candidates(t, 0, len(t))
        torn = {e for e, _ in ends[:-1] for a, b in s.pairs(t, 0, len(t)) if a <= e <= b}
        total = lambda cuts: sum(
            (dict(ends)[b] - 2 * s.TORN * (b in torn) if b < len(t) else 0) - s.SHORT * (b - a < s.SHORTEST) - s.LONG * max(0, b - a - s.LONGEST) for a, b in zip([0, *cuts], cuts)
        )
        every = ([*c, len(t)] for k in range(len(ends)) for c in itertools.combinations([e for e, _ in ends[:-1]], k))
        assert abs(total([b for _, b in s.split_piece(t, 0, len(t))]) - max(map(total, every))) < 1e-9


def test_layout():
    t = "3.2 Unit economics\n \nOne line\nbreak. Two.\n- Supplier: Xx Ltd. and more\n- 9 open\r\n\r\nKey risks　\n\n  Last"
    assert units(t) == ["3.2 Unit economics", "One line\nbreak.", "Two.", "- Supplier: Xx Ltd. and more", "- 9 open", "Key risks", "Last"]
    thai = "กระแสเงินสดพอใช้ราว 9 เดือน ราคาขายเฉลี่ยลดลงเล็กน้อย คู่ค้า 47 รายยังไม่ตอบรับข้อเสนอ"
    assert len(units(thai)) == 3


@pytest.mark.parametrize("text", ["", None, " ", "\n　\t", "...", "a", "“", "” . ! 」", "x" * 300_000, "A b. " * 20_000, "(" * 5_000 + "a. B" * 50])
def test_units_cover_all_that_is_not_blank(text):
    got, t = sentence_units(text), text or ""
    assert all(a < b <= c < d for (a, b), (c, d) in zip(got, got[1:])) and all(not t[a].isspace() and not t[b - 1].isspace() for a, b in got)
    held = set(i for a, b in got for i in range(a, b))
    assert all(i in held for i, c in enumerate(t) if not c.isspace())


def test_on_a_table(spark):
    df = spark.createDataFrame([(1, "Ab. Cd!"), (1, "Ab. Cd!"), (None, "E."), (2, None), (3, "")], "doc_id long, text string").withColumn("sent_start", F.lit("clash"))
    assert sorted((r.doc_id or 0, r.sent_start, r.sent_end) for r in sentences(df).collect()) == [(0, 0, 2), (1, 0, 3), (1, 0, 3), (1, 4, 7), (1, 4, 7)] and sentences(df.limit(0)).count() == 0
