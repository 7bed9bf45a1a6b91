"""Sections of structured articles (JATS XML). A row is an article, however long; only its walk is Python."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.documents import read, section_type

PIECE = "struct<title:string,sec_type:string,depth:int,content:string>"
PARSED = f"struct<pmid:string,doi:string,pmcid:string,abstract:array<{PIECE}>,body:array<{PIECE}>,whole:string>"

#: Articles of a batch that are held parsed at a time.
AT_ONCE = 100


def plain(element) -> str:
    return "" if element is None else " ".join("".join(element.itertext()).split())


def piece(sec, depth: int, content: str) -> dict:
    return {"title": plain(sec.find("title")), "sec_type": sec.get("sec-type", ""), "depth": depth, "content": content}


def parsed(xml: str | None) -> dict | None:
    """Ids, abstract and body of one article, sections in document order; None for what isn't XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    ids: dict[str, str] = {}
    meta = root.find(".//article-meta")  # a second one belongs to an inner article
    for found in meta.findall("article-id") if meta is not None else []:
        kind, value = found.get("pub-id-type", ""), (found.text or "").strip()
        if value and kind in ("pmid", "doi"):
            ids[kind] = value  # the last one counts
        elif value and kind in ("pmcid", "pmc"):
            ids.setdefault("pmcid", value)
    abstract, parts = root.find(".//abstract"), []
    if abstract is not None:
        parts = [piece(sec, 0, plain(sec)) for sec in abstract.findall("sec")] or [{"title": None, "sec_type": None, "depth": 0, "content": plain(abstract)}]
    body, ahead = [], [(sec, 0) for sec in reversed(root.findall(".//body/sec"))]
    while ahead:
        sec, depth = ahead.pop()
        body.append(piece(sec, depth, " ".join(filter(None, map(plain, sec.findall("p"))))))
        ahead.extend((inner, depth + 1) for inner in reversed(sec.findall("sec")))
    whole = None if parts or body else plain(root)
    return {"pmid": ids.get("pmid"), "doi": ids.get("doi", "").lower() or None, "pmcid": ids.get("pmcid"), "abstract": parts, "body": body, "whole": whole}


def parse(xml: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    columns = ["pmid", "doi", "pmcid", "abstract", "body", "whole"]
    for batch in xml:
        for start in range(0, len(batch), AT_ONCE):  # a batch's articles in parts, so that few are held as objects
            rows = [parsed(x) or dict.fromkeys(columns) for x in batch.iloc[start : start + AT_ONCE]]
            yield pd.DataFrame(rows, columns=columns)


def sections(articles: DataFrame, key: str = "pmid", xml: str = "xml", least: int = 80, most: int | None = None) -> DataFrame:
    """(key, xml_pmid, xml_doi, pmcid, order_idx, section_type, title, content) of articles.

    The abstract comes first, by its own sections if it has some, then the body's sections by their direct
    paragraphs; inner sections of up to `least` characters and sections without text don't count. An
    article without any section is one section `other` by itself, in full (most: its first characters
    only). What isn't XML gives no row; nor does an article without text.
    """
    rows = articles.select(key, F.pandas_udf(parse, PARSED)(F.col(xml)).alias("a"))
    made = lambda s, kind, title: F.struct(kind.alias("section_type"), title.alias("title"), s["content"].alias("content"))
    titled = lambda s, other: F.coalesce(F.nullif(s["title"], F.lit("")), other)

    def abstract_piece(s: Column) -> Column:
        whole = s["sec_type"].isNull()
        return made(s, F.when(whole, "abstract").otherwise(section_type(s["title"], s["sec_type"])), F.when(whole, "Abstract").otherwise(titled(s, F.lit("Abstract section"))))

    first = F.filter("a.abstract", lambda s: s["sec_type"].isNotNull() | (s["content"] != ""))
    told = F.filter("a.body", lambda s: (s["content"] != "") & ((s["depth"] == 0) | (F.length(s["content"]) > least)))
    kept = rows.select(key, "a", F.transform(first, abstract_piece).alias("front"), told.alias("told"))
    back = F.transform("told", lambda s, i: made(s, section_type(s["title"], s["sec_type"]), titled(s, F.concat(F.lit("Section "), (F.size("front") + i).cast("string")))))
    text = F.col("a.whole") if most is None else F.substring("a.whole", 1, most)
    alone = F.array(F.struct(F.lit("other").alias("section_type"), F.lit("Full text").alias("title"), text.alias("content")))
    every = F.concat("front", back)
    full = F.when(F.size(every) > 0, every).when(F.coalesce("a.whole", F.lit("")) != "", alone)
    out = kept.select(key, F.col("a.pmid").alias("xml_pmid"), F.col("a.doi").alias("xml_doi"), F.col("a.pmcid").alias("pmcid"), F.posexplode(full).alias("order_idx", "s"))
    return out.select(key, "xml_pmid", "xml_doi", "pmcid", "order_idx", "s.*")


def promoted_other(merged: DataFrame, key: str, least: int = 1500) -> DataFrame:
    """Merged sections (key, section_type, title, content) of type `other` as discussions, where they are long enough."""
    rest = merged.filter((F.col("section_type") == "other") & (F.length(F.trim("content")) >= least))
    return rest.select(key, F.lit("discussion").alias("section_type"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("discussion (from other)")).alias("title"), "content")


def articles_of_documents(spark, sf_dir: str) -> DataFrame:
    """Every document as an article: each line a section of one paragraph, titled by its first word."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(escaped, r"[\x00-\x08\x0B-\x1F]", " ")
    sec = lambda line: F.concat(F.lit("<sec><title>"), F.get(F.split(line, " "), F.lit(0)), F.lit("</title><p>"), line, F.lit("</p></sec>"))
    body = F.array_join(F.transform(F.split(clean, "\n"), sec), "")
    head = F.concat(F.lit('<article><front><article-meta><article-id pub-id-type="pmid">'), F.col("doc_id").cast("string"), F.lit("</article-id></article-meta></front><body>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, body, F.lit("</body></article>")).alias("xml"))


def article_sections_of_documents(spark, sf_dir: str) -> DataFrame:
    found = sections(articles_of_documents(spark, sf_dir), "doc_id")
    return found.groupBy("doc_id", "section_type").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"), F.count_if(F.col("xml_pmid") == F.col("doc_id").cast("string")).alias("own"))
