"""Merging by key: what an upsert does row by row, as one grouped fold over ordered arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.operators.checkpoints import checkpointed
from papertide.sources.corpus import Corpus

#: Strength of an evidence's origin and of an access class; fixed values.
GRANULARITY = {"fulltext": 3, "mineru_pdf": 2, "abstract": 1}
ACCESS = {"public": 2, "private": 1}
#: What an arriving relation says.
FIELDS = ["metric_value", "confidence", "section", "quote", "granularity", "polarity"]
#: Arrivals of a key from which they are many, and the parts that those of such a key are dealt to while they are judged.
MANY, SALTS = 100_000, 16


def strength(col: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(col == k, v) for k, v in ranks.items()], F.lit(0))


def filled(new: Column, old: Column) -> Column:
    return F.coalesce(F.nullif(new, F.lit("")), old)


def merge_relations(arrivals: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Fold relation rows of one key in order of arrival.

    A weaker origin changes nothing; an equal or stronger one takes over origin and polarity, appends
    its quote unless the quote is held already, keeps the greatest confidence, and fills section and
    metric where it has them. Rows without a pmid never merge: they come back as they are. The fold is made
    of partial aggregates; only a key's distinct quotes come together in one row. Arrivals are shuffled by
    their key once; keys of MANY arrivals go apart, where their rows are dealt to parts.
    """
    whole = arrivals.filter(F.col("pmid").isNotNull())
    many = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_pt_n")).filter(F.col("_pt_n") >= MANY)
    many = F.broadcast(checkpointed(many.select(*[F.col(k).alias(f"_pt_many_{i}") for i, k in enumerate(key)])))  # one for each MANY arrivals at most
    hot = F.lit(True)
    for i, k in enumerate(key):
        hot = hot & F.col(k).eqNullSafe(F.col(f"_pt_many_{i}"))
    few = folded_relations(whole.join(many, hot, "left_anti"), key, order, 1)
    loose = arrivals.filter(F.col("pmid").isNull()).select(*key, *FIELDS, F.lit(1).alias("arrivals"))
    return few.unionByName(folded_relations(whole.join(many, hot, "left_semi"), key, order, SALTS)).unionByName(loose)


def folded_relations(arrivals: DataFrame, key: list[str], order: str, parts: int) -> DataFrame:
    """The fold of merge_relations over rows with a pmid. With one part they are shuffled by their key once; else those
    of a key are judged in so many parts."""
    at, rank = F.col("_pt_at"), F.col("_pt_rank")
    # keys are compared as structs, in which nulls are equal
    keyed = arrivals.select(F.struct(*key).alias("_pt_key"), order, *FIELDS)
    keyed = keyed.repartition("_pt_key") if parts == 1 else keyed
    keyed = keyed.select("_pt_key", *FIELDS, F.struct(order, *FIELDS).alias("_pt_at"), strength(F.col("granularity"), GRANULARITY).alias("_pt_rank"))
    # a row is taken over unless a stronger one came before it: by strength, the first stronger arrival
    levels = range(max(GRANULARITY.values()))
    firsts = keyed.groupBy("_pt_key").agg(F.min("_pt_rank").alias("_pt_low"), F.max("_pt_rank").alias("_pt_high"), *[F.min(F.when(rank > n, at)).alias(f"_pt_{n}") for n in levels])
    mixed, on = firsts.filter("_pt_low < _pt_high").drop("_pt_low", "_pt_high"), ["_pt_key"]
    if parts > 1:
        mixed, on = mixed.withColumn("_pt_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*on, "_pt_part"]
        keyed = keyed.withColumn("_pt_part", F.pmod(F.xxhash64("_pt_at"), F.lit(parts)).cast("int"))
    weaker = F.lit(False)
    for n in levels:
        weaker = weaker | ((rank == n) & F.coalesce(F.col(f"_pt_{n}") < at, F.lit(False)))
    judged = keyed.join(mixed, on, "left").select("_pt_key", *FIELDS, "_pt_at", (~weaker).alias("_pt_taken"))
    taken = lambda value, when=True: F.max_by(value, F.when(F.col("_pt_taken") & when, at))
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    folded = judged.groupBy("_pt_key").agg(
        F.min("_pt_at").alias("_pt_first"), taken(F.col("metric_value"), held("metric_value")).alias("metric_value"), F.max(F.when(F.col("_pt_taken"), F.col("confidence"))).alias("confidence"),
        taken(F.col("section"), held("section")).alias("section"), taken(F.struct("granularity", "polarity")).alias("_pt_last"), F.count(F.lit(1)).cast("int").alias("arrivals"),
    )
    # a quote that came before is held already, so that only the first of equal ones matters
    quotes = judged.filter(F.col("_pt_taken") & held("quote")).groupBy("_pt_key", "quote").agg(F.min("_pt_at").alias("_pt_at"))
    listed = quotes.groupBy("_pt_key").agg(F.array_sort(F.collect_list(F.struct("_pt_at", "quote"))).alias("_pt_quotes"))

    def append(old: Column, new: Column) -> Column:
        return F.when(old == "", new["quote"]).when(F.contains(old, new["quote"]), old).otherwise(F.concat(old, F.lit("; "), new["quote"]))

    first = lambda c: F.coalesce(F.col(c), F.col(f"_pt_first.{c}")).alias(c)
    quote = F.coalesce(F.aggregate("_pt_quotes", F.lit(""), append), F.col("_pt_first.quote"))
    return folded.join(listed, "_pt_key", "left").select("_pt_key.*", first("metric_value"), "confidence", first("section"), quote.alias("quote"), "_pt_last.granularity", "_pt_last.polarity", "arrivals")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old_if_blank: list[str]) -> DataFrame:
    """new over old by key; in the stated text columns an empty new value leaves the old one."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    pick = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")) if c in keep_old_if_blank else F.coalesce(f"n.{c}", f"o.{c}")
    return o.join(n, on, "full").select(*[pick(c).alias(c) for c in old.columns])


def merge_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Papers by pmid, else by a doi that isn't empty: queries are united, filled texts overwrite, dates
    are patched only where the old precision was empty."""
    by_doi = old.filter(F.coalesce("doi", F.lit("")) != "").select("doi", F.col("pmid").alias("known"))
    pmids = old.select(F.col("pmid").alias("same"))
    keyed = new.join(pmids, F.col("pmid") == F.col("same"), "left").join(by_doi, "doi", "left").withColumn("pmid", F.coalesce("same", "known", "pmid")).drop("same", "known")
    place = F.row_number().over(Window.partitionBy("pmid").orderBy(F.desc("seq")))
    latest = keyed.withColumn("_n", place).filter("_n = 1").drop("_n", "seq")
    o, n = old.alias("o"), latest.alias("n")
    blank = F.coalesce(F.col("o.date_precision"), F.lit("")) == ""
    text = lambda c: filled(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    date = lambda c: F.when(blank, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    none = F.array().cast("array<string>")
    return o.join(n, F.col("o.pmid") == F.col("n.pmid"), "full").select(
        F.coalesce("o.pmid", "n.pmid").alias("pmid"), text("doi"), text("title"), text("abstract"), date("pub_date"), date("year"), date("date_precision"),
        F.array_sort(F.array_union(F.coalesce("o.source_queries", none), F.coalesce("n.source_queries", none))).alias("source_queries"),
    )


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities by lower-cased, trimmed name and type; the strongest access class stays."""
    named = rows.select(F.lower(F.trim("name")).alias("name"), "type", "access_class")
    best = F.max(F.struct(strength(F.col("access_class"), ACCESS).alias("rank"), F.coalesce("access_class", F.lit("unknown")).alias("access_class")))
    return named.groupBy("name", "type").agg(best.alias("best")).select("name", "type", "best.access_class")


def replace_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """New sections in place of all old sections of the same papers."""
    return old.join(new.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(new)


def orphan_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.join(relations.select("name", "type").distinct(), ["name", "type"], "left_anti")


def latest_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def entities_of(corpus: Corpus) -> DataFrame:
    """Every entity of the corpus with its papers and, for data sets, its access class."""
    # a paper's entities are told apart first, which needs no shuffle where relations lie by paper
    counts = corpus.relations.select("pmid", "type", "name").distinct().groupBy("type", "name").agg(F.count("pmid").alias("papers"))
    datasets = corpus.datasets.withColumn("type", F.lit("Dataset"))
    return counts.join(datasets, ["type", "name"], "left").select("type", "name", "papers", F.coalesce("access_class", F.lit("unknown")).alias("access_class"))


def merged_lines(spark, sf_dir: str) -> DataFrame:
    """Order lines as arrivals of one relation each: (order, part) merged in line order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    arrivals = lines.select(
        F.col("l_orderkey").alias("pmid"), F.col("l_partkey").alias("part"),
        F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"),
        F.lit(None).cast("string").alias("metric_value"),
        F.round(F.col("l_quantity")).cast("long").alias("confidence"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("section"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("quote"),
        F.when(F.col("l_linestatus") == "F", "fulltext").otherwise("abstract").alias("granularity"),
        F.col("l_linestatus").alias("polarity"),
    )
    merged = merge_relations(arrivals, ["pmid", "part"])
    return merged.groupBy("granularity", "polarity", "arrivals").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.sum(F.length("quote")).alias("quote_chars"))


def papers_without_relations(spark, sf_dir: str) -> DataFrame:
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("pmid"), F.col("o_orderstatus").alias("status"))


def new_links(known: DataFrame, arriving: DataFrame, key: list[str], order: str) -> DataFrame:
    """The arriving links whose key isn't known yet, the first of each by order; a key with a null links nothing."""
    whole = arriving.dropna(subset=key)
    first = whole.groupBy(*key).agg(F.min_by(F.struct(*[c for c in whole.columns if c not in key]), order).alias("_l")).select(*key, "_l.*")
    return first.join(known.select(*key), key, "left_anti").select(*arriving.columns)


def upserted_journals(journals: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arriving (seq, name, abbr, issn) with the journal_id that each means, and the journals (journal_id, name, abbr,
    issn) with the new ones.

    A row means the journal of its issn, else that of its name as written; else it is new. New rows of one
    name are one journal, as the first of them tells it, and rows of its issn mean it too. Blank names and
    issns match nothing; rows without a name are no journals and mean the one of their issn or none. Of known
    journals that share a key the least id counts. New ids follow the greatest one, in the order of names.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = arriving.select("seq", blank("name").alias("name"), blank("abbr").alias("abbr"), blank("issn").alias("issn"))

    def meant(rows: DataFrame, known: DataFrame) -> DataFrame:
        by = lambda c: known.filter(blank(c).isNotNull()).groupBy(blank(c).alias(f"_{c}")).agg(F.min("journal_id").alias(f"_by_{c}"))
        found = rows.join(by("issn"), F.col("issn") == F.col("_issn"), "left").join(by("name"), F.col("name") == F.col("_name"), "left")
        return found.withColumn("journal_id", F.coalesce("_by_issn", "_by_name")).drop("_issn", "_name", "_by_issn", "_by_name")

    fresh = meant(rows, journals).filter("journal_id IS NULL AND name IS NOT NULL").groupBy("name").agg(F.min_by(F.struct("seq", "abbr", "issn"), "seq").alias("_f")).select("name", "_f.*")
    # a name whose issn an earlier new name has brought means that one
    first = fresh.groupBy("issn").agg(F.min("seq").alias("_least")).filter("issn IS NOT NULL").withColumnRenamed("issn", "_i")
    fresh = fresh.join(first, F.col("issn") == F.col("_i"), "left").filter("_least IS NULL OR seq = _least")
    top = journals.agg(F.coalesce(F.max("journal_id"), F.lit(0)).alias("_top"))
    dealt = checkpointed(fresh.repartitionByRange("name").withColumn("_p", F.spark_partition_id()))  # ranges are sampled, so they are kept
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_ahead"))  # a row for each partition
    ranked = dealt.join(F.broadcast(ahead), "_p").withColumn("_place", F.col("_ahead") + F.row_number().over(Window.partitionBy("_p").orderBy("name")))
    new = ranked.join(F.broadcast(top)).select((F.col("_top") + F.col("_place")).cast(journals.schema["journal_id"].dataType).alias("journal_id"), "name", "abbr", "issn")
    every = journals.select("journal_id", "name", "abbr", "issn").unionByName(new)
    return meant(rows, every), every
