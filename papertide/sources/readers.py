"""Landed inputs: bibliographic XML, JSON, spreadsheets as CSV, Markdown files; and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.operators.strings import indel_similarity, similar_pairs

from papertide.functions.dates import parts_date

ARTICLE = """
MedlineCitation STRUCT<
    PMID: STRING,
    Article: STRUCT<
        ArticleTitle: STRING,
        Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_Label: STRING, _VALUE: STRING>>>,
        Journal: STRUCT<ISSN: STRING, Title: STRING, ISOAbbreviation: STRING,
            JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, Month: STRING, Day: STRING, MedlineDate: STRING>>>,
        AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING>>>,
        PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>>,
    KeywordList: STRUCT<Keyword: ARRAY<STRING>>>,
PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>>,
_corrupt_record STRING
"""


def article_id(kind: str) -> Column:
    return F.get(F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == kind), F.lit(0))["_VALUE"]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Papers from article-set XML; rows that can't be parsed or lack a title are left out."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(ARTICLE).load(path)
    a, when = "MedlineCitation.Article", "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    part = lambda x: F.concat_ws(": ", F.nullif(x["_Label"], F.lit("")), x["_VALUE"])
    date = parts_date(F.col(f"{when}.Year"), F.col(f"{when}.Month"), F.col(f"{when}.Day"), F.col(f"{when}.MedlineDate"))
    return raw.filter("_corrupt_record IS NULL").select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        F.trim(f"{a}.ArticleTitle").alias("title"),
        F.array_join(F.transform(f"{a}.Abstract.AbstractText", part), "\n").alias("abstract"),
        date.alias("d"),
        F.col(f"{a}.Journal.Title").alias("journal_name"), F.col(f"{a}.Journal.ISOAbbreviation").alias("journal_abbr"), F.col(f"{a}.Journal.ISSN").alias("issn"),
        article_id("doi").alias("doi"), article_id("pmc").alias("pmc_id"),
        F.transform(f"{a}.AuthorList.Author", lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])).alias("authors"),
        F.col(f"{a}.PublicationTypeList.PublicationType").alias("pub_types"), F.col("MedlineCitation.KeywordList.Keyword").alias("keywords"),
    ).select("*", "d.*").drop("d").filter("coalesce(title, '') <> ''")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A spreadsheet's CSV as strings, by the first encoding that leaves no replacement character."""
    for encoding in encodings:
        rows = spark.read.option("header", True).option("encoding", encoding).csv(path)
        odd = F.contains(F.concat_ws("", *[F.col(f"`{c}`") for c in rows.columns]), F.lit("\ufffd"))
        if rows.filter(odd).isEmpty() and not any("\ufffd" in c for c in rows.columns):
            return rows
    return rows


def new_only(landed: DataFrame, known: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows of a load whose ids aren't known yet, once each."""
    return landed.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def mapped_ids(papers: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """papers with pmc_id from the first lookup (pmid, pmc_id), else from the second; ids get their prefix."""
    prefixed = lambda c: F.when(c.startswith("PMC"), c).otherwise(F.concat(F.lit("PMC"), c))
    a, b = first.select("pmid", prefixed(F.col("pmc_id")).alias("_a")), second.select("pmid", prefixed(F.col("pmc_id")).alias("_b"))
    return papers.drop("pmc_id").join(a, "pmid", "left").join(b, "pmid", "left").withColumn("pmc_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def with_citations(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Citation counts for papers without a source; a miss is marked unavailable, an abstract filled only where missing."""
    f = found.select("pmid", F.col("citation_count").alias("_c"), F.col("source").alias("_s"), F.col("abstract").alias("_x"))
    open_row = F.coalesce("citation_source", F.lit("")) == ""
    joined = papers.join(f, "pmid", "left")
    return joined.withColumns({
        "citation_count": F.when(open_row & F.col("_s").isNotNull(), F.col("_c")).otherwise(F.col("citation_count")),
        "citation_source": F.when(open_row, F.coalesce("_s", F.lit("unavailable"))).otherwise(F.col("citation_source")),
        "abstract": F.when(open_row, F.coalesce(F.nullif("abstract", F.lit("")), "_x")).otherwise(F.col("abstract")),
    }).drop("_c", "_s", "_x")


def token_sort_key(name: Column) -> Column:
    """The words of a name in lower case, between blanks, sorted, repeats included."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda w: w != "")), " ")


def issn_key(issn: Column) -> Column:
    """An issn in capitals with a plain hyphen in its middle; null for blanks."""
    bare = F.regexp_replace(F.translate(F.trim(F.coalesce(issn, F.lit(""))), "–—", "--"), " ", "")
    whole = F.when(~F.contains(bare, F.lit("-")) & (F.length(bare) == 8), F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(bare)
    return F.nullif(F.upper(whole), F.lit(""))


def name_key(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(""))


def cascade(rows: DataFrame, journals: DataFrame, steps: list[tuple[Column, Column]]) -> DataFrame:
    """rows with journal_id by the first of some equalities (key of the row, key of the journal); of journals that share a
    key the last id counts."""
    tries = []
    for number, (own, key) in enumerate(steps):
        table = journals.groupBy(key.alias(f"_k{number}")).agg(F.max("journal_id").alias(f"_j{number}")).filter(F.col(f"_k{number}").isNotNull())
        rows = rows.join(table, own == F.col(f"_k{number}"), "left").drop(f"_k{number}")
        tries.append(f"_j{number}")
    return rows.withColumn("journal_id", F.coalesce(*tries)).drop(*tries)


def match_journals(imported: DataFrame, journals: DataFrame, threshold: int = 85) -> DataFrame:
    """imported (row_id, issn, eissn, name, abbr if it has one) with journal_id: by issn, eissn, name, abbreviation, then
    by like names.

    Names are alike by their sorted words, in percent of what insertions and deletions leave; the most
    alike from the threshold on is taken, the least id of equals. journals may have an abbr, too. Names
    meet by their rarest characters, as many as the threshold lets them miss, so that no common word
    brings all of them together. A row is matched against the journals as they are, not against rows
    before it.
    """
    abbr = lambda df: F.col("abbr") if "abbr" in df.columns else F.lit(None).cast("string")
    rows = cascade(imported, journals, [(issn_key(F.col("issn")), issn_key(F.col("issn"))), (issn_key(F.col("eissn")), issn_key(F.col("issn"))), (name_key(F.col("name")), name_key(F.col("name"))), (name_key(abbr(imported)), name_key(abbr(journals)))])
    left = rows.filter("journal_id IS NULL").select("row_id", token_sort_key(F.col("name")).alias("_x"))
    right = journals.select(F.col("journal_id").alias("_id"), token_sort_key(F.col("name")).alias("_y"))
    near = similar_pairs(left, right, "_x", "_y", threshold, indel_similarity).join(right, "_y")
    best = left.join(near, "_x").groupBy("row_id").agg(F.min(F.struct((-F.col("similarity")).alias("r"), "_id")).alias("b")).select("row_id", F.col("b._id").alias("_f"))
    return rows.join(best, "row_id", "left").withColumn("journal_id", F.coalesce("journal_id", "_f")).drop("_f")


def linked_papers(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """papers (journal_id, issn, journal_name, journal_abbr) whose journal is unknown get it by issn, name or abbreviation."""
    known, unknown = papers.filter("journal_id IS NOT NULL"), papers.filter("journal_id IS NULL").drop("journal_id")
    low = lambda c: F.nullif(F.lower(F.coalesce(c, F.lit(""))), F.lit(""))
    found = cascade(unknown, journals, [(issn_key(F.col("issn")), issn_key(F.col("issn"))), (low(F.col("journal_name")), name_key(F.col("name"))), (low(F.col("journal_abbr")), name_key(F.col("abbr")))])
    return known.unionByName(found)
