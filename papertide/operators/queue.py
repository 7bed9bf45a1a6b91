"""The queue of papers whose texts are fetched and whose relations are extracted, and its marks.

Papers: pmid, doi, pmc_id, title, abstract, year, pub_types (array), full_text_status, extraction_done, study_type,
full_text_fetched_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of titles, words of titles, publication types and lengths of the rules; fixed values, in order.
NOTICE_TITLES = ("correction:", "corrigendum:", "erratum:", "retraction:", "withdrawn:", "publisher correction:", "author correction:")
ISSUE_TITLES = ("special issue:", "special issue ", "special section:")
EDITOR_TITLES = ("in this issue:", "editor's note:", "editors' note:", "from the editor:")
MEETING_TITLES = ("meeting report", "workshop report", "conference report", "conference proceedings", "proceeding of the", "proceedings of the")
MEETING_ABSTRACTS = ("this meeting brought together", "this workshop brought together", "workshop on translational")
SKIPPED_TYPES = ("editorial", "news", "interview", "newspaper article", "patient education handout", "published erratum", "retracted publication", "expression of concern")
ERRATUM_TYPES = ("published erratum", "retracted publication")
COMMENT_TYPES = ("letter", "comment", "commentary")
OPINION_WORDS = ("anecdotal", "viewpoint", "commentary", "opinion")
LATE_TITLES = ("correction:", "corrigendum:", "erratum:", "comment on:")
CORRECTS = "corrects the article"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def some(test, values: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for value in values:
        hit = hit | test(F.lit(value))
    return hit


def skip_reason(title: Column, abstract: Column, pub_types: Column) -> Column:
    """Why a paper has nothing to extract, null if it may have; nulls count as empty. The first rule decides."""
    low_title, body = F.lower(F.trim(text(title))), F.trim(text(abstract))
    low, size = F.lower(body), F.length(body)
    types = F.lower(F.array_join(F.coalesce(pub_types, F.array().cast("array<string>")), " "))
    begins = lambda values: some(lambda v: F.startswith(low_title, v), values)
    rules = [
        (begins(NOTICE_TITLES), F.lit("erratum/correction notice")),
        (begins(ISSUE_TITLES), F.lit("special issue / section notice")),
        (begins(EDITOR_TITLES), F.lit("editor note")),
        (some(lambda v: F.contains(low_title, v), MEETING_TITLES), F.lit("meeting/workshop/proceedings report")),
        (some(lambda v: F.contains(low, v), MEETING_ABSTRACTS), F.lit("meeting/workshop summary")),
        (F.startswith(low_title, F.lit("comment on:")) & (size < 200), F.lit("comment/reply (no substantive abstract)")),
    ]
    corrects = F.contains(low, F.lit(CORRECTS))
    for kind in SKIPPED_TYPES:
        has = F.contains(types, F.lit(kind))
        rules.append((has & ((size < 200) | corrects), F.lit("published erratum")) if kind in ERRATUM_TYPES else (has, F.lit(f"non-extractable pub_type ({kind})")))
    rules += [(F.contains(types, F.lit(kind)) & (size < 400), F.lit(f"short {kind} (thin abstract)")) for kind in COMMENT_TYPES]
    rules += [
        ((size < 80) & corrects, F.lit("doi correction stub")),
        ((size <= 250) & some(lambda v: F.contains(low, v), OPINION_WORDS), F.lit("thin commentary/viewpoint")),
    ]
    return F.coalesce(*[F.when(rule, reason) for rule, reason in rules])


def study_type(pub_types: Column) -> Column:
    """The kind of study that publication types tell of; null where they don't."""
    types = F.lower(F.array_join(F.coalesce(pub_types, F.array().cast("array<string>")), " "))
    has = lambda *values: some(lambda v: F.contains(types, v), values)
    return F.when(has("meta-analysis", "meta analysis"), "meta_analysis").when(has("review"), "review").when(has("clinical trial", "clinical study", "validation study"), "clinical_study")


def extraction_queue(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers that wait for extraction, with their places in the order: notices last, then papers with an
    available text, then with a PDF, then the others; latest years first, years unknown last, ties by pmid. limit: the first n
    (None: all). Papers without an abstract don't wait; a null mark of extraction counts as none."""
    waiting = papers.filter(~F.coalesce("extraction_done", F.lit(False)) & (text(F.col("abstract")) != ""))
    title, abstract = F.lower(text(F.col("title"))), F.lower("abstract")
    notice = some(lambda v: F.startswith(title, v), LATE_TITLES) | ((F.length("abstract") < 80) & F.contains(abstract, F.lit(CORRECTS)))
    ready = F.when(F.col("full_text_status") == "available", 0).when(F.col("full_text_status") == "pdf_available", 1).otherwise(2)
    ordered = waiting.withColumns({"notice_rank": F.when(notice, 2).otherwise(0), "text_rank": ready}).orderBy("notice_rank", "text_rank", F.desc_nulls_last("year"), "pmid")
    return ordered if limit is None else ordered.limit(limit)


def needing_full_text(papers: DataFrame, status: str = "pending") -> DataFrame:
    return papers.filter(F.col("pmid").isNotNull() & (F.col("full_text_status") == status))


def marked_full_text(papers: DataFrame, marks: DataFrame, at) -> DataFrame:
    """papers with the full-text status of marks (pmid, status, pmc_id, one row a pmid); a null pmc_id keeps the old."""
    new = marks.select("pmid", F.col("status").alias("_status"), F.col("pmc_id").alias("_pmc"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    return papers.join(new, "pmid", "left").withColumns({
        "full_text_status": F.when(hit, F.col("_status")).otherwise(F.col("full_text_status")),
        "pmc_id": F.coalesce("_pmc", "pmc_id"),
        "full_text_fetched_at": F.when(hit, F.lit(at)).otherwise(F.col("full_text_fetched_at")),
    }).drop("_status", "_pmc", "_hit")


def marked_extracted(papers: DataFrame, marks: DataFrame) -> DataFrame:
    """papers with the extraction marks and study types of marks (pmid, study_type, one row a pmid)."""
    new = marks.select("pmid", F.col("study_type").alias("_type"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    return papers.join(new, "pmid", "left").withColumns({"extraction_done": hit | F.coalesce("extraction_done", F.lit(False)), "study_type": F.when(hit, F.col("_type")).otherwise(F.col("study_type"))}).drop("_type", "_hit")


def mismatches(papers: DataFrame, embedded: DataFrame) -> DataFrame:
    """(pmid, doi, xml_pmid, xml_doi) of papers whose document (pmid, xml_pmid, xml_doi) names another paper.

    Ids that either side lacks (null or blank) agree with any; DOIs are compared without case and outer blanks.
    """
    plain = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = papers.select("pmid", "doi").join(embedded, "pmid")
    other_pmid = plain(F.col("xml_pmid")) != F.col("pmid").cast("string")
    other_doi = F.lower(plain(F.col("xml_doi"))) != F.lower(plain(F.col("doi")))
    return both.filter(F.coalesce(other_pmid, F.lit(False)) | F.coalesce(other_doi, F.lit(False))).select("pmid", "doi", "xml_pmid", "xml_doi")


def reset_mismatches(papers: DataFrame, sections: DataFrame, embedded: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """papers and sections after documents of other papers are let go: no text, no id, to be extracted anew."""
    wrong = mismatches(papers, embedded).select("pmid").distinct()
    hit = F.coalesce("_hit", F.lit(False))
    none = lambda name: F.when(~hit, F.col(name))
    reset = papers.join(wrong.withColumn("_hit", F.lit(True)), "pmid", "left").withColumns({
        "full_text_status": F.when(hit, F.lit("unavailable")).otherwise(F.col("full_text_status")), "pmc_id": none("pmc_id"),
        "extraction_done": ~hit & F.col("extraction_done"), "study_type": none("study_type"),
        "full_text_fetched_at": F.when(hit, F.lit(at)).otherwise(F.col("full_text_fetched_at")),
    }).drop("_hit")
    return reset, sections.join(wrong, "pmid", "left_anti")


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skip_reasons_of_texts(spark, sf_dir: str) -> DataFrame:
    """Every document and conversation turn as a paper: its first line the title, its whole text the abstract, its
    words in the place of publication types."""
    docs = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = read(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    told = docs.unionByName(turns)
    line = F.get(F.split(text(F.col("text")), "\n"), F.lit(0))
    words = F.split(text(F.col("text")), " ")
    return told.select("kind", "id", "turn", skip_reason(line, F.col("text"), words).alias("reason"), study_type(words).alias("study_type"))


def orders_as_papers(spark, sf_dir: str) -> DataFrame:
    """Orders as papers of the queue: priority the title, priority and segment the abstract, finished ones extracted."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("pmid"), F.concat(F.lit("10.1/C"), F.col("o_custkey").cast("string")).alias("doi"), F.lit(None).cast("string").alias("pmc_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Erratum: "), F.col("c_mktsegment"))).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat_ws(" ", "o_orderpriority", "c_mktsegment")).alias("abstract"),
        F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("pub_types"),
        F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderpriority") == "5-LOW", "pdf_available").otherwise("pending").alias("full_text_status"),
        (F.col("o_orderstatus") == "O").alias("extraction_done"), F.lit(None).cast("string").alias("study_type"), F.lit(None).cast("date").alias("full_text_fetched_at"),
    )


def queue_of_orders(spark, sf_dir: str) -> DataFrame:
    return extraction_queue(orders_as_papers(spark, sf_dir)).select("pmid", "notice_rank", "text_rank", F.col("year").alias("yr"))


def marked_orders(spark, sf_dir: str) -> DataFrame:
    """Orders after their first suppliers' marks: shipped lines bring a text, returned ones a study type; by outcome."""
    papers, lines = orders_as_papers(spark, sf_dir), read(spark, sf_dir, "lineitem")
    texts = lines.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("pmid")).agg(F.lit("available").alias("status"), F.concat(F.lit("PMC"), F.min("l_suppkey").cast("string")).alias("pmc_id"))
    types = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("pmid")).agg(F.lit("review").alias("study_type"))
    after = marked_extracted(marked_full_text(papers, texts, "2001-08-01"), types)
    return after.groupBy("full_text_status", "extraction_done", "study_type").agg(F.count(F.lit(1)).alias("papers"), F.count("pmc_id").alias("with_pmc"), F.count("full_text_fetched_at").alias("fetched"))


def mismatched_orders(spark, sf_dir: str) -> DataFrame:
    """Orders held against documents that name the next customer where the order is partly filled, and another order
    where its first line is returned."""
    papers, orders = orders_as_papers(spark, sf_dir), read(spark, sf_dir, "orders")
    embedded = orders.select(
        F.col("o_orderkey").alias("pmid"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_orderkey") + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)).cast("string")).alias("xml_pmid"),
        F.concat(F.lit("10.1/c"), (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).cast("string")).alias("xml_doi"),
    )
    return mismatches(papers, embedded)
