"""String joins against plain loops, and the mapping cascade rule by rule."""

import random
from difflib import SequenceMatcher

from papertide.operators import mapping, strings

ALIAS = "place int, alias string, target string"


def words(seed, n, letters="abc é", longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values] + [(None,)], f"{name} string")


def test_containments(spark):
    texts, needles = words(1, 60, longest=14) + ["%_%", "a.b*c"], words(2, 80, longest=4) + ["%", "_", ".b*", "zzzz", "ab" * 20]
    got = {tuple(r) for r in strings.containments(frame(spark, texts, "text"), frame(spark, needles, "needle")).collect()}
    assert got == {(t, n) for t in texts for n in needles if t and n and n in t}
    assert strings.containments(frame(spark, texts, "text"), frame(spark, [], "needle")).count() == 0


def test_similar_pairs(spark):
    left, right = words(3, 50, longest=12), words(4, 50, longest=12) + ["a" * 250]
    left.append("ab" * 120)
    of = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    for percent in (55, 80, 100):
        got = {(r.a, r.b): r.similarity for r in strings.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), "a", "b", percent).collect()}
        assert got == {(a, b): of(a, b) for a in left for b in right if a and b and of(a, b) >= percent / 100}


def gaps_of(spark, texts, **more):
    rows = lambda values, columns: spark.createDataFrame([(i, *v) for i, v in enumerate(values)], columns)
    catalogue = spark.createDataFrame([(0, "D1", "胃癌", "Gastric", 100), (1, "D2", "胃腺癌", "", 900), (2, "D3", "乳腺癌", None, None), (3, "D4", "肺癌", "lung", 5)], "place int, disease_id string, name string, name_en string, cases int")
    settings = {
        "codes": rows([("gastric cancer", "F1"), ("gastric", "F0"), ("NPC", "F2")], ALIAS), "keywords": rows([("stomach", "胃癌"), ("mamma", "乳腺"), ("no hit here", "zz")], ALIAS), "catalogue": catalogue,
        "aliases": rows([("polyp", "A1"), ("colon polyp", "A2")], ALIAS), "names": spark.createDataFrame([(0, "N1", "鼻咽", "Nasal"), (1, "N2", "甲状腺", "Thyroid")], "place int, disease_id string, zh string, en string"),
        "matches": spark.createDataFrame([(0, "", "x", "肝炎", None, 0.9, "ok"), (1, "M1", "x", "慢性肝炎", "", 0.91, "ok"), (2, "M2", "y", "炎", None, 0.99, "ok")], "place long, code string, name string, raw string, normalized string, confidence double, status string"),
    }
    found = mapping.mapped_gaps(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, gap_text string"), **(settings | more)).collect()
    return [(r.disease_id, round(r.confidence, 4), r.rule) for r in sorted(found, key=lambda r: r.id)]


def test_cascade(spark):
    texts = ["A Gastric Cancer gap with stomach", "only gastric", "npc alone", "NPC here", "the stomach polyp", "mamma", "肝炎 gap", "a colon polyp gap", "Nasal thing", "甲状腺 gap", "nothing here", "", "  ", None, "lung", "no hit here"]
    got = gaps_of(spark, texts)
    assert got == [
        ("F1", 0.96, "code"), ("F0", 0.96, "code"), (None, 0.0, "none"), ("F2", 0.96, "code"), ("D1", 0.92, "search"), ("D3", 0.92, "search"), ("M1", 0.91, "mention"), ("A2", 0.95, "alias"), ("N1", 0.9, "name"), ("N2", 0.9, "name"), (None, 0.0, "none"),
        (None, 0.0, "empty"), (None, 0.0, "empty"), (None, 0.0, "empty"), ("D4", 0.35, "broad"), (None, 0.0, "none"),
    ]


def test_search_prefers_likeness_then_cohort(spark):
    # 胃 stands in two names: one of two characters is likelier than one of three, but 900 cases are worth 0.09
    keywords = spark.createDataFrame([(0, "belly", "胃")], ALIAS)
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = max([("D1", like("胃", "胃癌") + 0.01), ("D2", like("胃", "胃腺癌") + 0.09)], key=lambda x: x[1])[0]
    assert gaps_of(spark, ["a belly"], keywords=keywords) == [(want, 0.92, "search")]


def test_known_names(spark):
    known = spark.createDataFrame([(0, "thyroids"), (1, "nasal")], "place int, known string")
    assert gaps_of(spark, ["q"], known=known) == [("N1", 1.0, "fuzzy")]  # a known name is most like itself
    assert gaps_of(spark, ["q"], known=known, own_names=False) == [("N1", 1.0, "fuzzy")]
    known = spark.createDataFrame([(0, "thyroids"), (1, "nase")], "place int, known string")
    assert gaps_of(spark, ["q"], known=known, own_names=False) == [("N2", round(14 / 15, 4), "fuzzy")]
    assert gaps_of(spark, ["q"], known=spark.createDataFrame([(0, "xx")], "place int, known string"), own_names=False) == [(None, 0.0, "none")]


def test_mentions(spark):
    rows = mapping.resolved_mentions(
        spark.createDataFrame([(" Lung ",), ("lung cancer",), ("",), (None,), ("zzz",)], "mention string"),
        spark.createDataFrame([(0, "B", "b", "LUNG CANCER", None, None, None), (1, "A", "a", "x", "lung", 0.5, "s"), (2, "A", "a", "lung", "", 0.6, "s"), (3, None, "n", "lung", None, 0.1, "s")], "place long, code string, name string, raw string, normalized string, confidence double, status string"),
        spark.createDataFrame([(0, "A", "lung", "", 1), (1, "C", "Lung cancer of all", "", 1)], "place int, disease_id string, name string, name_en string, cases int"),
    ).collect()
    assert {(r.mention, r.code, r.place, r.source) for r in rows} == {("Lung", "B", 0, "text_disease_match"), ("Lung", "A", 1, "text_disease_match"), ("Lung", "C", 1, "disease_dict"), ("lung cancer", "B", 0, "text_disease_match"), ("lung cancer", "A", 1, "text_disease_match"), ("lung cancer", "C", 1, "disease_dict")}


def test_overlapping_sets(spark):
    rng = random.Random(9)
    sets = lambda n: [(i, rng.randint(0, 2), sorted(set(rng.choices("abcdefghij", k=rng.randint(0, 7))))) for i in range(n)]
    left, right = sets(60), sets(60)
    a, b = spark.createDataFrame(left, "x int, g int, a array<string>"), spark.createDataFrame(right, "y int, g int, b array<string>")
    share = lambda p, q: len(set(p) & set(q)) / max(1, len(set(p) | set(q)))
    for percent in (50, 55, 80, 100):
        met = {(r.x, r.y) for r in strings.overlapping(a, b, percent, ("g",)).collect()}
        want = {(i, j) for i, g, p in left for j, k, q in right if g == k and p and q and 100 * len(set(p) & set(q)) >= percent * len(set(p) | set(q))}
        assert want <= met and all(share(left[i][2], right[j][2]) > 0 for i, j in met)
    # a token that all rows hold brings none of them together
    crowd = spark.range(300).selectExpr("id", "array('all', concat('o', id), concat('p', id)) AS a")
    assert strings.overlapping(crowd, crowd.selectExpr("id AS other", "a AS b"), 55).filter("id <> other").count() == 0
