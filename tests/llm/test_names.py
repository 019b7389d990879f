import itertools

from pyspark.sql import functions as F

from foliospark.llm import names

LISTED = ["Calverine International News Service", "Drivu Review", "The Stabriö Tribune", "Kruesco & Quosu Analytics", "Vedrae Bay Chronicle", "Resto Energy Bulletin", "The Resto Register", "Gogei Energy Bulletin"]
MEANT = {
    "CALVERINE INTERNATIONAL NEWS SERVICE": 0, "Calverine Intl. News Svc.": 0, "Calverine": 0, "Calverine-International-News-Service": 0, "Intnl": None, "Divu Rev..": 1, "Review of Drivu": 1, "Review, Drivu": 1, "DrivuReview": 1, "drivureview.example": 1,
    "Stabrioe Tribune": 2, "Stabrio Tribune": 2, "K.Q.A.": 3, "KQA": 3, "Quosu & Kruesco Analytics": 3, "Kruesco and Quosu Analytics Inc": 3, "Vedrae Bay": 4, "Resto": None, "Resto Register": 6, "Forum post": None, "Gogei Energy Buletin": 7,
}


def test_spellings_of_listed_names(spark):
    listed = spark.createDataFrame(list(enumerate(LISTED)), "id int, name string")
    asked = spark.createDataFrame([(n,) for n in [*MEANT, *MEANT, LISTED[0], "", "  ", "...", None, "x" * 50_000]], "name string").withColumn("scope", F.lit(1))
    got = {r.name: r.id for r in names.link_to_list(asked, listed).collect()}
    assert got == {k: v for k, v in MEANT.items() if v is not None}
    assert names.link_to_list(asked.limit(0), listed).count() == 0 and names.link_to_list(asked, listed.limit(0)).count() == 0


PEOPLE = [
    ("a", "Margaret Riovaß", 1), ("a", "M. Riovaß", 1), ("a", "RIOVASS Margaret", 1), ("a", "Riovaß, M.K.", 1), ("a", "Peggy Riovaß", 1), ("a", "Dr. Margaret “Peggy” Riovaß, PhD", 1), ("a", "Margaret Rioavß", 1), ("a", "Leonard Riovaß", 2), ("a", "Len Riovaß", 2),
    ("b", "Margaret Riovaß", 3), ("b", "William de la Fioanda", 4), ("b", "DE LA FIOANDA William", 4), ("b", "Bill de la Fioanda (CEO)", 4), ("b", "W. de la Fioanda", 4), ("b", "Kwame Sioesco", 5), ("b", "Katherine Sioesco", 6), ("b", "K. Sioesco", 7),
]


def test_people_of_one_scope(spark):
    df = spark.createDataFrame([(s, n) for s, n, _ in PEOPLE] * 2 + [(None, "x y"), ("a", None), ("a", " "), ("a", "?")], "scope string, name string").withColumn("root", F.lit(1))
    got = {(r.scope, r.name): r.root for r in names.person_groups(df).collect()}
    assert set(got) == {(s, n) for s, n, _ in PEOPLE}
    for (s, n, p), (t, m, q) in itertools.combinations(PEOPLE, 2):
        assert ((s, got[s, n]) == (t, got[t, m])) == (p == q), (n, m)
    assert names.person_groups(df.limit(0)).count() == 0


def test_candidates_miss_no_pair(spark):
    words = ["abcdef", "abcdxf", "bcdefa", "xyzxyz", "abc", "defabc", "zzabcdefzz", "a", "", "abcdef abcdef"]
    held = spark.createDataFrame([("s", w, names.grams(w.split())) for w in words], "scope string, name string, grams array<string>")
    got = {(r.a, r.b) for r in names.candidates(held, held, 0.4, True).collect()}
    sets = {w: set(names.grams(w.split())) for w in words}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(words, 2) if (n := len(sets[a] & sets[b])) and n >= 0.4 * max(len(sets[a]), len(sets[b]))}
    assert want <= got and all(sets[a] & sets[b] for a, b in got)


def test_edit_distance():
    assert [names.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("", "a"))] == [0, 1, 1, 3, 1]


def test_people_with_initials_and_a_mistyped_short_surname(spark):
    people = [("a", "Bsetröm K.", 1), ("a", "Kwame Beström", 1), ("b", "Feraß K.", 2), ("b", "Kwame Feiraß", 2), ("c", "Uli Kaearo", 3), ("c", "Ulrich Kaerao", 3), ("c", "I. Keiaß", 4), ("c", "Isabella Keißa", 4)]
    df = spark.createDataFrame([(s, n) for s, n, _ in people], "scope string, name string")
    got = {(r.scope, r.name): r.root for r in names.person_groups(df).collect()}
    for (s, n, p), (t, m, q) in itertools.combinations(people, 2):
        assert ((s, got[s, n]) == (t, got[t, m])) == (p == q), (n, m)


def test_person_candidates_miss_no_likely_pair(spark):
    spelled = [n for _, n, _ in PEOPLE] + ["Bsetröm K.", "Kwame Beström", "Kwmae Besttröm", "Beström", "Bob Li", "Robert Lie", "De Lafioanda W.", "William Kraonda", "Wiloiam Kroanda"]
    df = spark.createDataFrame([("s", n) for n in spelled], "scope string, name string").distinct()
    got = {(r.a, r.b) for r in names.person_candidates(df).collect()}
    likely = {(a, b) for a, b in itertools.combinations(sorted(set(spelled)), 2) if names.person_likeness(a, b, {}) > 0}
    assert likely and likely <= got


def test_initials_stand_for_given_names(spark):
    like = lambda a, b: names.person_likeness(a, b, {"": 3.0}) > 0.78
    assert like("Kegsiøn K.", "Kegisøn, Kwame") and like("K. Kegisøn", "Kegisøn Kwame") and like("Kriosborough, M.L.", "Margaret Kriosborough") and like("Riovaß, M.K.", "Margaret K. Riovaß")
    assert not like("Kriosborough, M.L.", "Leonard Kriosborough") and not like("Queitromann, P.T.", "Theodore Queitromann")
    assert like("Rick Gaemilanda", "Richarrd Gaemilanda") and like("Doothea Zolttinsøn", "Dora Zolttinsøn") and not like("Rick Gaemilanda", "Richenda Gaemilanda") and not like("Uli Fiaß", "Yevgeny Fiaß")


def test_every_token_has_its_weight(spark):
    common = [(f"w{i} w{i + 1}",) for i in range(25_000)]
    listed = spark.createDataFrame([*common, ("w0 rareone",)], "name string")
    got = {r.token: r.weight for r in names.token_weights(listed, False).collect()}
    assert len(got) == 25_002 and max(got, key=got.get) in ("rareone", "w25000") and got["rareone"] > got["w1"]


def test_scores_are_those_of_all_weights(spark):
    spelled = ["Margaret Riovaß", "M. Riovaß", "Peggy Riovass", "Leonard Riovaß", "Bsetröm K.", "Kwame Beström"]
    df = spark.createDataFrame([("s", n) for n in spelled], "scope string, name string")
    w = names.token_weights(df, True)
    table = {r.token: r.weight for r in w.collect()}
    pairs = spark.createDataFrame([("s", a, b) for a, b in itertools.combinations(spelled, 2)], "scope string, a string, b string")
    got = {(r.a, r.b): r.likeness for r in names.scored(pairs, w, True).collect()}
    assert got == {(a, b): names.person_likeness(a, b, table) for a, b in itertools.combinations(spelled, 2)}
