"""The corpus that the analytic operators read: papers, journals and evidence-bearing relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The relation that belongs to each type of entity; fixed values of the schema.
RELATION_OF = {
    "Disease": "TARGETS_DISEASE",
    "Method": "APPLIES_METHOD",
    "Task": "PERFORMS_TASK",
    "Tissue": "OPERATES_ON",
    "Modality": "USES_MODALITY",
    "Dataset": "USES_DATASET",
    "Metric": "ACHIEVES_METRIC",
    "Limitation": "REPORTS_LIMITATION",
}


@dataclass(frozen=True)
class Corpus:
    """papers: pmid, title, year, pub_date, date_precision, citation_count, study_type, full_text_status,
    extraction_done, journal_id. journals: journal_id, if_cents (impact factor x 50000), quartile.
    relations: pmid, relation, type, name, section, polarity, quote, metric_value, one row per
    (pmid, relation, name). datasets: name, access_class. stated: the relations of some types by
    themselves, where they can be had for less than all; quoted=False leaves quote and metric_value out,
    within=papers (pmid) leaves out all other papers before anything is joined."""

    papers: DataFrame
    journals: DataFrame
    relations: DataFrame
    datasets: DataFrame
    stated: Callable[..., DataFrame] | None = None

    def of(self, kind: str) -> DataFrame:
        """Relation rows whose object has this type, through the relation that belongs to it."""
        return self.typed(kind).filter(F.col("relation") == RELATION_OF[kind])

    def typed(self, *kinds: str) -> DataFrame:
        """Relation rows whose object has one of these types, through any relation."""
        return self.stated(*kinds) if self.stated else self.relations.filter(F.col("type").isin(*kinds))

    def placed(self, *kinds: str) -> DataFrame:
        """typed() by place only: pmid, relation, type, name, section and polarity."""
        rows = self.stated(*kinds, quoted=False) if self.stated else self.typed(*kinds)
        return rows.select("pmid", "relation", "type", "name", "section", "polarity")

    def placed_within(self, papers: DataFrame, *kinds: str) -> DataFrame:
        """placed() of these papers (pmid) alone."""
        if not self.stated:
            return self.placed(*kinds).join(papers, "pmid", "left_semi")
        return self.stated(*kinds, quoted=False, within=papers).select("pmid", "relation", "type", "name", "section", "polarity")

    @cached_property
    def judged(self) -> DataFrame:
        """Papers with their journal's impact factor and quartile."""
        return self.papers.join(self.journals, "journal_id", "left")


def section_of(number: Column) -> Column:
    names = ["methods", "results", "discussion", "limitations", "future_work"]
    return F.element_at(F.array(*map(F.lit, names)), (number % 5 + 1).cast("int"))


def from_star(spark: SparkSession, sf_dir: str) -> Corpus:
    """Play the corpus' roles with a star schema of orders, lines, parts, suppliers and customers.

    The lines are joined once and each gives all its relations, so that the large table is scanned and
    shuffled once however many roles a query uses; a query of some roles makes no others, and joins the
    suppliers only if one of them is named after a supplier. Lines are dealt by their paper before they
    give relations, so that what groups or joins relations by paper needs no further shuffle of them.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, customer = t("orders"), t("customer")
    day = F.to_date("o_orderdate")
    papers = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("pmid"),
        F.lower(F.concat_ws(" ", "o_orderpriority", "c_mktsegment")).alias("title"),
        F.year(day).alias("year"),
        day.alias("pub_date"),
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'year' WHEN o_orderkey % 10 = 1 THEN 'unknown' WHEN o_orderkey % 10 <= 3 THEN 'month' ELSE 'day' END").alias("date_precision"),
        F.floor(F.col("o_totalprice") / 5000).cast("long").alias("citation_count"),
        F.col("o_orderpriority").alias("study_type"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'pending' ELSE 'unavailable' END").alias("full_text_status"),
        (F.col("o_orderstatus") != "P").alias("extraction_done"),
        F.col("o_custkey").alias("journal_id"),
    )
    journals = customer.select(
        F.col("c_custkey").alias("journal_id"),
        F.col("c_name").alias("journal"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("long")).alias("if_cents"),
        F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Q1' WHEN 'BUILDING' THEN 'Q2' WHEN 'FURNITURE' THEN 'Q3' WHEN 'HOUSEHOLD' THEN 'Q4' END").alias("quartile"),
    )
    lines, part, supplier = t("lineitem"), t("part"), t("supplier")
    name = lambda *c: F.lower(F.concat_ws(" ", *c))
    kinds_of = list(RELATION_OF)
    told_by = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    role = lambda kind, what, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kinds_of.index(kind)).alias("kind"), what.alias("name")))
    roles = {
        "Disease": role("Disease", name("p_name", "s_name"), F.col("l_linenumber") == 1),
        "Method": role("Method", name("p_brand", "p_name")),
        "Task": role("Task", name("p_type", F.col("p_size").cast("string"))),
        "Dataset": role("Dataset", F.lower("p_name")),
        "Metric": role("Metric", F.concat(F.lit("discount_"), F.round(F.col("l_discount") * 100).cast("int").cast("string"))),
        "Limitation": role("Limitation", F.lower(F.concat_ws(" by ", "p_name", "s_name")), F.col("l_returnflag") == "R"),
    }
    place = ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_linestatus"]
    quote = F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("quote")  # the last of the order, so that places are the same without it

    nothing = F.lit(None).cast("struct<kind:int,name:string>")

    def of(*kinds: str, quoted: bool = True, within: DataFrame | None = None) -> DataFrame:
        seen = F.struct(*place, *[quote] * quoted)
        told = [roles[kind] for kind in kinds if kind in roles] or [nothing]
        object_ = F.explode(F.array_compact(F.array(*told))) if len(told) > 1 else told[0]
        chosen = lines if within is None else lines.join(within.select(F.col("pmid").alias("l_orderkey")), "l_orderkey", "left_semi")
        wide = chosen.join(part, F.col("l_partkey") == F.col("p_partkey"))
        by_supplier = bool({"Disease", "Limitation"} & set(kinds))
        if by_supplier:
            wide = wide.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        if not quoted:  # only what a limitation's first line and names are told by, where they are
            limits = (F.col("l_returnflag") == "R") & F.lit("Limitation" in kinds)
            named = limits | (F.col("l_linenumber") == 1)
            thin = [F.when(limits, F.col(c)).alias(c) for c in place[1:]] + [F.when(named, F.col("s_name")).alias("s_name")] * by_supplier
            wide = wide.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "p_name", "p_brand", "p_type", "p_size", *thin)
        each = wide.repartition("l_orderkey").select(F.col("l_orderkey").alias("pmid"), seen.alias("seen"), object_.alias("o")).filter("o IS NOT NULL").select("pmid", "o.*", "seen")
        # the first line that states a relation gives its evidence
        first = each.groupBy("pmid", "kind", "name").agg(F.min("seen").alias("seen"))
        first = first.select("pmid", told_by(RELATION_OF.values()).alias("relation"), told_by(kinds_of).alias("type"), "name", "seen")
        evidence = [F.col("seen.quote").alias("quote"), F.when(F.col("type") == "Metric", F.col("seen.l_extendedprice")).alias("metric_value")]
        return first.select(
            "pmid", "relation", "type", "name",
            section_of(F.col("seen.l_linenumber")).alias("section"),
            F.when((F.col("type") == "Limitation") & (F.col("seen.l_linestatus") == "O"), "hypothesized").otherwise("asserted").alias("polarity"),
            *evidence * quoted,
        )

    relations = of(*roles)
    datasets = part.groupBy(F.lower("p_name").alias("name")).agg(F.min(F.struct("p_partkey", "p_size")).alias("first")).select(
        "name", F.expr("CASE first.p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'unknown' END").alias("access_class")
    )
    return Corpus(papers, journals, relations, datasets, of)


#: The same roles in DuckDB's SQL, as the beginning of a WITH clause.
STAR_SQL = """
WITH papers AS (
    SELECT o_orderkey AS pmid, lower(o_orderpriority || ' ' || c_mktsegment) AS title,
           CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(o_orderdate AS DATE) AS pub_date,
           CASE WHEN o_orderkey % 10 = 0 THEN 'year' WHEN o_orderkey % 10 = 1 THEN 'unknown'
                WHEN o_orderkey % 10 <= 3 THEN 'month' ELSE 'day' END AS date_precision,
           CAST(floor(o_totalprice / 5000) AS BIGINT) AS citation_count, o_orderpriority AS study_type,
           CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'pending' ELSE 'unavailable' END AS full_text_status,
           o_orderstatus <> 'P' AS extraction_done, o_custkey AS journal_id
    FROM orders JOIN customer ON o_custkey = c_custkey
),
journals AS (
    SELECT c_custkey AS journal_id, c_name AS journal,
           CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS if_cents,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Q1' WHEN 'BUILDING' THEN 'Q2' WHEN 'FURNITURE' THEN 'Q3'
                WHEN 'HOUSEHOLD' THEN 'Q4' END AS quartile
    FROM customer
),
judged AS (SELECT p.*, j.journal, j.if_cents, j.quartile FROM papers p LEFT JOIN journals j ON p.journal_id = j.journal_id),
lines AS (
    SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
),
stated AS (
    SELECT l_orderkey AS pmid, 'TARGETS_DISEASE' AS relation, 'Disease' AS type, lower(p_name || ' ' || s_name) AS name, lines.* FROM lines WHERE l_linenumber = 1
    UNION ALL SELECT l_orderkey, 'APPLIES_METHOD', 'Method', lower(p_brand || ' ' || p_name), lines.* FROM lines
    UNION ALL SELECT l_orderkey, 'PERFORMS_TASK', 'Task', lower(p_type || ' ' || CAST(p_size AS VARCHAR)), lines.* FROM lines
    UNION ALL SELECT l_orderkey, 'USES_DATASET', 'Dataset', lower(p_name), lines.* FROM lines
    UNION ALL SELECT l_orderkey, 'ACHIEVES_METRIC', 'Metric', 'discount_' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), lines.* FROM lines
    UNION ALL SELECT l_orderkey, 'REPORTS_LIMITATION', 'Limitation', lower(p_name || ' by ' || s_name), lines.* FROM lines WHERE l_returnflag = 'R'
),
relations AS (
    SELECT pmid, relation, type, name,
           CASE l_linenumber % 5 WHEN 0 THEN 'methods' WHEN 1 THEN 'results' WHEN 2 THEN 'discussion'
                WHEN 3 THEN 'limitations' ELSE 'future_work' END AS section,
           CASE WHEN type = 'Limitation' AND l_linestatus = 'O' THEN 'hypothesized' ELSE 'asserted' END AS polarity,
           lower(p_type || ' ' || p_brand) AS quote,
           CASE WHEN type = 'Metric' THEN l_extendedprice END AS metric_value
    FROM (
        SELECT *, row_number() OVER (
            PARTITION BY pmid, relation, type, name
            ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_linestatus, lower(p_type || ' ' || p_brand)
        ) AS place
        FROM stated
    ) WHERE place = 1
),
datasets AS (
    SELECT name, CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'unknown' END AS access_class
    FROM (SELECT lower(p_name) AS name, p_size, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey, p_size) AS place FROM part)
    WHERE place = 1
)
"""
