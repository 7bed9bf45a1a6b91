"""From words to diseases of a catalogue: mentions, and gap texts by a cascade of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.operators.strings import containments, similar_pairs, similarity

#: What a search of the catalogue lists for an alias, a token, a mention and a whole text; least similarity of a name.
BY_ALIAS, BY_TOKEN, BY_MENTION, BY_TEXT, FUZZY = 10, 5, 10, 3, 55
#: Chinese words of a text that are looked up as mentions, and characters of a text that are searched for.
WORDS, HEAD = 6, 20
#: Words of a gap text, and its Chinese ones; fixed values.
TOKEN, CHINESE = r"[a-zA-Z一-鿿]{2,}", r"[一-鿿]{2,8}"


def searched(keywords: DataFrame, catalogue: DataFrame, limit: int) -> DataFrame:
    """(keyword, place, disease_id, name, cases): the first `limit` entries of a catalogue (place, disease_id, name,
    name_en, cases) that hold each keyword in their id or a name, in any case."""
    hay = F.lower(F.concat_ws(" ", "disease_id", F.coalesce("name", F.lit("")), F.coalesce("name_en", F.lit(""))))
    entries = catalogue.withColumn("_hay", hay)
    asked = keywords.select("keyword", F.lower("keyword").alias("_low")).distinct()
    met = containments(entries, asked, "_hay", "_low").join(asked, "_low").join(entries, "_hay")
    place = F.row_number().over(Window.partitionBy("keyword").orderBy("place"))
    return met.withColumn("_place", place).filter(F.col("_place") <= limit).select("keyword", "place", "disease_id", "name", "cases")


def best_of(found: DataFrame, like: Column, key: str = "keyword") -> DataFrame:
    """(key, disease_id, name): of each key's entries the one most like the wanted text, large cohorts a little ahead;
    the first of equals."""
    score = similarity(like, F.coalesce("name", F.lit(""))) + F.least(F.coalesce("cases", F.lit(0)), F.lit(1000)) / 10000.0
    best = found.withColumn("_score", score).groupBy(key).agg(F.max_by(F.struct("disease_id", "name"), F.struct("_score", -F.col("place"))).alias("_best"))
    return best.select(key, "_best.disease_id", "_best.name")


def resolved_mentions(mentions: DataFrame, matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(mention, place, code, name, raw, normalized, confidence, status, source), one row for each code of a mention.

    matches (place, code, name, raw, normalized, confidence, status): those whose raw or normalized
    wording holds the mention or is held by it, in any case, count first, in their order; then the
    first entries of the catalogue that hold it. The first of each code stays. Wordings meet by grams
    in both directions, so that neither table is met whole. Blank mentions, empty wordings and
    matches without a code name nothing.
    """
    asked = mentions.select(F.trim("mention").alias("mention")).filter("mention <> ''").distinct().withColumn("_key", F.lower("mention"))
    wording = F.explode(F.array_distinct(F.array(F.lower("raw"), F.lower("normalized"))))
    told = matches.filter("code <> ''").withColumn("_word", wording).filter("_word <> ''")
    first = told.groupBy("_word", "code").agg(F.min_by(F.struct("place", "name", "raw", "normalized", "confidence", "status"), "place").alias("_m"))
    words = first.select("_word").distinct()
    held = containments(words, asked, "_word", "_key").unionByName(containments(asked, words, "_key", "_word")).distinct()
    hits = held.join(asked, "_key").join(first, "_word").select("mention", "code", F.lit(0).alias("_rank"), "_m.*", F.lit("text_disease_match").alias("source"))
    known = searched(asked.withColumnRenamed("mention", "keyword"), catalogue, BY_MENTION).filter("disease_id <> ''").select(
        F.col("keyword").alias("mention"), F.col("disease_id").alias("code"), F.lit(1).alias("_rank"), F.col("place").cast("long").alias("place"), "name", F.col("keyword").alias("raw"), F.col("name").alias("normalized"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("status"), F.lit("disease_dict").alias("source"),
    )
    rows = hits.unionByName(known)
    one = rows.groupBy("mention", "code").agg(F.min_by(F.struct("_rank", "place", "name", "raw", "normalized", "confidence", "status", "source"), F.struct("_rank", "place")).alias("_x"))
    return one.select("mention", "code", "_x.*")


def nearest_names(known: DataFrame, names: DataFrame, least: int = FUZZY) -> DataFrame:
    """(known, disease_id, name, similarity): known names (known) and the entries of names (place, disease_id, zh, en)
    that either name of is like, in hundredths at least; the best of each entry."""
    each = names.select("place", "disease_id", F.explode(F.array_distinct(F.array("zh", "en"))).alias("name"))
    pairs = similar_pairs(known, each, "known", "name", least)
    best = pairs.join(each, "name").groupBy("known", "disease_id").agg(F.max(F.struct("similarity", "name")).alias("_b"))
    return best.select("known", "disease_id", "_b.name", "_b.similarity")


def mapped_gaps(
    gaps: DataFrame, codes: DataFrame, keywords: DataFrame | None, catalogue: DataFrame | None, aliases: DataFrame, names: DataFrame,
    known: DataFrame | None = None, matches: DataFrame | None = None, own_names: bool = True,
) -> DataFrame:
    """gaps (gap_text) with disease_id, confidence and rule: the first rule of the cascade that finds a disease.

    1 code (.96): the longest alias of codes (place, alias, target) within the text as written or in lower
    case. 2 search (.92): the longest alias of keywords (place, alias, target) whose keyword finds entries
    of the catalogue, the entry most like it; then search_token (.85): the first word that is such an alias
    or Chinese. 3 mention (.75 to .95): the first of the text's first Chinese words that resolves. 4 alias
    (.95): the longest of aliases (place, alias, target). 5 fuzzy: the known name most like a disease's,
    from .55; with own_names a known name is also compared with itself, so that any known name settles
    on the first disease with 1.0, as in the cascade that this follows. 6 name (.9): the first of names
    (place, disease_id, zh, en) within the text. 7 alias_token (.85): the first word that is an alias. 8
    broad (.35): an entry of the catalogue that holds the text's first characters. 9 none (0). Rules 2, 3
    and 8 need a catalogue, 3 also matches, 5 known names (place, known). Blank and null texts: empty (0).
    Texts that repeat are mapped once; lists of any size are met by grams. Empty aliases are none.
    """
    texts = gaps.select("gap_text").filter("trim(gap_text) <> ''").distinct().withColumn("_low", F.trim(F.lower("gap_text")))
    words = texts.select("gap_text", F.posexplode(F.regexp_extract_all("gap_text", F.lit(TOKEN), F.lit(0))).alias("_at", "_token"))
    proposals = []

    def propose(rows: DataFrame, rule: int, name: str, order: list[Column], confidence: Column, disease: Column) -> None:
        cells = [F.col("gap_text"), F.lit(rule).alias("_rule"), F.array(*[o.cast("double") for o in order]).alias("_order"), F.lit(name).alias("rule"), confidence.cast("double").alias("confidence"), disease.alias("disease_id")]
        proposals.append(rows.select(*cells))

    def within(rows: DataFrame, alias: str, raw: bool) -> DataFrame:
        """Rows of a list beside the texts that hold its alias, in lower case or, where raw, as written."""
        low = containments(texts, rows, "_low", alias).join(texts, "_low")
        both = low.unionByName(containments(texts, rows, "gap_text", alias).join(texts, "gap_text")).distinct() if raw else low
        return both.join(rows, alias)

    longest = [-F.length("alias"), F.col("place")]
    propose(within(codes, "alias", True), 1, "code", longest, F.lit(0.96), F.col("target"))
    if catalogue is not None and keywords is not None:
        listed = keywords.select("place", "alias", F.col("target").alias("keyword")).filter("keyword <> ''")
        best = best_of(searched(listed, catalogue, BY_ALIAS), F.col("keyword"))
        propose(within(listed.join(best, "keyword"), "alias", False), 2, "search", longest, F.lit(0.92), F.col("disease_id"))
        chinese = F.when(F.col("_token").rlike(r"[一-鿿]"), F.col("_token"))
        tokens = words.join(listed.groupBy("alias").agg(F.max_by("keyword", "place").alias("_kw")), F.lower("_token") == F.col("alias"), "left").withColumn("keyword", F.coalesce("_kw", chinese)).filter("keyword IS NOT NULL").select("gap_text", "_at", "keyword")
        best = best_of(searched(tokens, catalogue, BY_TOKEN), F.col("keyword"))
        propose(tokens.join(best, "keyword"), 3, "search_token", [F.col("_at")], F.lit(0.85), F.col("disease_id"))
        if matches is not None:
            several = F.slice(F.regexp_extract_all("gap_text", F.lit(CHINESE), F.lit(0)), 1, WORDS)
            chinese_words = texts.select("gap_text", F.posexplode(several).alias("_at", "mention"))
            hits = resolved_mentions(chinese_words, matches, catalogue)
            top = hits.groupBy("mention").agg(F.min_by(F.struct("code", "confidence", "source"), F.struct("_rank", "place")).alias("_t")).select("mention", "_t.*")
            base = F.when(F.col("source") == "text_disease_match", 0.88).otherwise(0.75)
            propose(chinese_words.join(top, "mention"), 4, "mention", [F.col("_at")], F.greatest(base, F.least(F.lit(0.95), F.col("confidence"))), F.col("code"))
    propose(within(aliases, "alias", False), 5, "alias", longest, F.lit(0.95), F.col("target"))
    if known is not None:
        listed = known.filter("known <> ''")
        if own_names:
            one = listed.select(F.lit(1.0).alias("similarity")).limit(1).join(names.agg(F.min_by("disease_id", "place").alias("disease_id")))
        else:
            near = nearest_names(listed, names).join(listed, "known").join(names.select("disease_id", F.col("place").alias("_n")), "disease_id")
            one = near.agg(F.max_by(F.struct("similarity", "disease_id"), F.struct("similarity", -F.col("place"), -F.col("_n"))).alias("_o")).filter("_o IS NOT NULL").select("_o.*")
        propose(texts.join(F.broadcast(one)), 6, "fuzzy", [F.lit(0)], F.col("similarity"), F.col("disease_id"))  # one row, the same for all texts
    zh = within(names.select("place", "disease_id", F.col("zh").alias("alias")), "alias", True).filter(F.contains("gap_text", "alias"))
    en = within(names.select("place", "disease_id", F.lower("en").alias("alias")), "alias", False)
    propose(zh.unionByName(en), 7, "name", [F.col("place")], F.lit(0.9), F.col("disease_id"))
    targets = aliases.groupBy("alias").agg(F.max_by("target", "place").alias("target"))
    propose(words.join(targets, F.lower("_token") == F.col("alias")), 8, "alias_token", [F.col("_at")], F.lit(0.85), F.col("target"))
    if catalogue is not None:
        heads = texts.select("gap_text", F.substring("gap_text", 1, HEAD).alias("keyword"))
        found = heads.join(searched(heads, catalogue, BY_TEXT), "keyword")
        propose(best_of(found, F.col("gap_text"), "gap_text"), 9, "broad", [F.lit(0)], F.lit(0.35), F.col("disease_id"))
    first = reduce(DataFrame.unionByName, proposals).groupBy("gap_text").agg(F.min_by(F.struct("disease_id", "confidence", "rule"), F.struct("_rule", "_order")).alias("_p"))
    out = gaps.join(first, "gap_text", "left")
    missing = F.when(F.coalesce(F.trim("gap_text"), F.lit("")) == "", "empty").otherwise("none")
    return out.select(*gaps.columns, "_p.disease_id", F.coalesce("_p.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_p.rule", missing).alias("rule"))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lists by hand for the part names of the star schema: (alias, target) in order.
CODES = [("blue bolt", "C1"), ("hot", "C2"), ("cold gear", "C3"), ("Brand#9", "C4")]
KEYWORDS = [("anvil", "anvil"), ("red widget", "widget"), ("small", "small gear"), ("plate", "old"), ("brand", "nothing"), ("economy", "ring")]
ALIASES = [("tiny", "A1"), ("tiny ring", "A2"), ("promo", "A3"), ("bolt", "A4")]
NAMES = [("N1", "gizmo", "Large Standard"), ("N2", "rod", "Medium"), ("N3", "gear", "cold small")]
KNOWN = ["old gizmos", "mediums", "small cold"]


def lists(spark, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, " + columns)


def catalogue_of_parts(spark, sf_dir: str) -> DataFrame:
    """Part names as a catalogue: cases are the parts of a name, the least key its place."""
    parts = read(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("place"), F.count(F.lit(1)).alias("cases")).select("place", F.concat(F.lit("P"), "place").alias("disease_id"), "name", F.lit("").alias("name_en"), "cases")


def gaps_of_parts(spark, sf_dir: str) -> DataFrame:
    """Parts as gap texts (name, type, brand) through the whole cascade but for Chinese words and known names."""
    gaps = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("gap_text"))
    found = mapped_gaps(gaps, lists(spark, CODES, "alias string, target string"), lists(spark, KEYWORDS, "alias string, target string"), catalogue_of_parts(spark, sf_dir), lists(spark, ALIASES, "alias string, target string"), lists(spark, NAMES, "disease_id string, zh string, en string"))
    return found.select("p_partkey", "gap_text", "disease_id", F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct"), "rule")


def titles_of_parts(spark, sf_dir: str) -> DataFrame:
    """Part names alone, without a catalogue: aliases, names and words decide, or the known name nearest to a disease's."""
    gaps = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("gap_text"))
    known = lists(spark, [(k,) for k in KNOWN], "known string")
    found = mapped_gaps(gaps, lists(spark, CODES, "alias string, target string"), None, None, lists(spark, ALIASES, "alias string, target string"), lists(spark, NAMES, "disease_id string, zh string, en string"), known, own_names=False)
    return found.select("p_partkey", "disease_id", F.round(F.col("confidence") * 10000).cast("long").alias("confidence_bp"), "rule")


def similar_part_names(spark, sf_dir: str) -> DataFrame:
    """Names of parts, and words of brands and types, that are alike by their matching blocks."""
    parts = read(spark, sf_dir, "part")
    words = parts.select(F.concat_ws(" ", F.lower("p_type"), F.substring("p_name", 1, 5)).alias("b"))
    pairs = similar_pairs(parts.select(F.col("p_name").alias("a")), words, "a", "b", FUZZY)
    return pairs.select("a", "b", F.round(F.col("similarity") * 10000).cast("long").alias("similarity_bp"))


def mentions_of_parts(spark, sf_dir: str) -> DataFrame:
    """Names with brands as mentions; parts as matches, their type the code, and a catalogue of part names."""
    parts = read(spark, sf_dir, "part")
    mentions = parts.select(F.explode(F.array(F.concat_ws(" ", "p_name", "p_brand"), F.element_at(F.split("p_name", " "), -1), "p_brand")).alias("mention"))
    matches = parts.select(F.col("p_partkey").alias("place"), F.col("p_type").alias("code"), F.col("p_name").alias("name"), F.col("p_name").alias("raw"), F.expr("IF(p_size % 2 = 0, upper(p_brand), NULL)").alias("normalized"), (F.col("p_size") / 100).alias("confidence"), F.lit("confirmed").alias("status"))
    found = resolved_mentions(mentions, matches, catalogue_of_parts(spark, sf_dir))
    return found.select("mention", "code", F.col("place").cast("long").alias("place"), "raw", "normalized", F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct"), "source")
