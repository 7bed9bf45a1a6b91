"""Headings, clean text, journals by like names and the coverage of a focus, by the rules as stated."""

import random
import re

from pyspark.sql import functions as F

from papertide.operators import documents, gap, strings
from papertide.sources import readers
from papertide.sources.corpus import RELATION_OF, Corpus


def plain_sections(text, least):
    clean = lambda t: re.sub(r"\s+", " ", re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]+\)", " ", t))).strip()
    parts = re.split(r"^(#{1,3})\s+(.+?)\s*$", text, flags=re.MULTILINE)
    found = [("Preamble", clean(parts[0]))] + [(parts[i + 1].strip(), clean(parts[i + 2])) for i in range(1, len(parts) - 2, 3)]
    found = [f for f in found if len(f[1]) >= least]
    return [(i, *f) for i, f in enumerate(found)] or [(0, "Full document", clean(text))]


def test_headings(spark):
    rng = random.Random(4)
    bits = ["# Methods", "##\tResults ", "### x y\n\n", "#### deep", "#no blank", "#  \nnext line", " # not first", "word " * 5, "a![x](y)b", "[](u)", "[t](u)", "![]()", "　wide ", "# ", "#", "\n", "\r\n", "# Discussion ###"]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["a![x](y)b", "x"]
    rows = documents.markdown_sections(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", least=4).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.order_idx, r.title, r.content))
    for i, text in enumerate(texts):
        assert sorted(got[i]) == plain_sections(text, 4), text
    assert [r.section_type for r in rows if r.id == 200] == ["other"] and got[200] == [(0, "Full document", "a b")] or got[200] == [(0, "Preamble", "a b")]


def plain_lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_indel():
    rng = random.Random(6)
    for _ in range(400):
        x, y = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert strings.indel(x, y) == (2 * plain_lcs(x, y) / (len(x) + len(y)) if x or y else 1.0)


def test_like_journals(spark):
    rng = random.Random(8)
    words = ["journal", "of", "the", "pathology", "imaging", "cancer", "letters", "annals", "review", "digital"]
    known = [(i, rng.choice([None, f"{i:04}-{i:04}"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice([None, f"J{i}."])) for i in range(60)]
    asked = []
    for i in range(80):
        name = rng.choice(known)[2]
        cut = rng.randrange(len(name))
        asked.append((i, rng.choice([None, None, f"{i:04}{i:04}", "0003–0003"]), rng.choice([None, " 0005 - 0005"]), rng.choice([name[:cut] + name[cut + 1 :], " ".join(sorted(name.split(), reverse=True)), name.upper(), "zz qq"]), rng.choice([None, None, "j7. "])))
    by = lambda f: {k: j[0] for j in known if (k := f(j))}
    issns, names, abbrs = by(lambda j: j[1]), by(lambda j: j[2]), by(lambda j: j[3] and j[3].lower())
    key = lambda s: " ".join(sorted(s.lower().split()))
    clean = lambda s: (lambda c: c[:4] + "-" + c[4:] if "-" not in c and len(c) == 8 else c)((s or "").strip().replace(" ", "").replace("–", "-"))
    want = {}
    for i, issn, eissn, name, abbr in asked:
        found = issns.get(clean(issn)) if issn else None
        found = found if found is not None else issns.get(clean(eissn)) if eissn else None
        found = found if found is not None else names.get(name.lower())
        found = found if found is not None else abbrs.get(abbr.strip().lower()) if abbr else None
        if found is None:
            a = key(name)
            best = max(known, key=lambda j: (2 * plain_lcs(a, key(j[2])) / (len(a) + len(key(j[2]))), -j[0]))
            found = best[0] if 2 * plain_lcs(a, key(best[2])) / (len(a) + len(key(best[2]))) >= 0.85 else None
        want[i] = found
    journals = spark.createDataFrame(known, "journal_id int, issn string, name string, abbr string")
    got = {r.row_id: r.journal_id for r in readers.match_journals(spark.createDataFrame(asked, "row_id int, issn string, eissn string, name string, abbr string"), journals).collect()}
    assert got == want
    papers = spark.createDataFrame([(1, 5, None, None, None), (2, None, "00070007", None, None), (3, None, None, known[9][2].upper(), None), (4, None, None, None, "j7."), (5, None, "", "", "")], "pmid int, journal_id int, issn string, journal_name string, journal_abbr string")
    linked = {r.pmid: r.journal_id for r in readers.linked_papers(papers, journals).collect()}
    assert linked == {1: 5, 2: issns.get("0007-0007"), 3: names[known[9][2]], 4: abbrs.get("j7."), 5: None}


def test_focus_coverage(spark):
    papers = spark.createDataFrame([(i, "about flu" if i == 1 else "t", True) for i in range(6)], "pmid long, title string, extraction_done boolean")
    rows = [(0, "Disease", "flu a"), (2, "Disease", "flu b"), (3, "Disease", "flu b"), (4, "Disease", "cold"), (1, "Method", "m"), (4, "Method", "n"), (2, "Limitation", "l")]
    relations = spark.createDataFrame([(p, RELATION_OF[k], k, n) for p, k, n in rows] + [(2, "RELATED_TO", "Method", "other"), (2, "RELATED_TO", "Limitation", "l2")], "pmid long, relation string, type string, name string")
    c = Corpus(papers, spark.createDataFrame([], "journal_id int"), relations, papers)
    row = gap.corpus_focus_coverage(c, "flu").first()
    assert (row.total_papers, row.focus_papers, row.limitation_relations, row.methods, row.diseases, row.top_diseases, row.analysis_ready) == (6, 4, 1, 1, 2, "flu b (2)|flu a (1)", False)
    assert row.warnings.startswith("Focus subset has only 4 papers")
    none = gap.corpus_focus_coverage(c, "zzz").first()
    assert (none.focus_papers, none.diseases, none.top_diseases, len(none.warnings.split("|"))) == (0, 0, "", 2)
