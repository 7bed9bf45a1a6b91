"""Markdown sections in full, and the query over all documents."""

import os

import pytest

import __spark_entry__ as entry
from papertide.operators import documents

DATA = "/root/testdata/sf0.001"


def test_sections_are_not_cut(spark):
    long, whole = "word " * 6_000, "# a\nxxxxx\n" * 6_000
    docs = spark.createDataFrame([(1, f"# Methods\n{long}"), (2, whole), (3, f"# Results\n{long}"), (3, "no heading"), (4, None)], "id int, text string")
    size = lambda rows: sorted((r["id"], r["section_type"], len(r["content"] or "")) for r in rows.collect())
    assert size(documents.markdown_sections(docs, "id", "text")) == [(1, "methods", 29_999), (2, "other", 59_999), (3, "other", 10), (3, "results", 29_999), (4, "other", 0)]
    assert size(documents.markdown_sections(docs, "id", "text", most=12_000, whole=50_000))[:2] == [(1, "methods", 12_000), (2, "other", 50_000)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query_gives_every_document_in_full(spark):
    import re

    texts = {r["doc_id"]: r["text"] for r in documents.read(spark, DATA, "documents").collect()}
    found = {}
    for r in entry.queries()["x04_markdown_sections"](spark, DATA).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(texts)
    clean = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", t))).strip(" ")
    for key, text in texts.items():
        if not re.search(r"(^|\n)#{1,3} ", text or ""):
            assert [r["content"] for r in found[key]] == [clean(text)]
