"""Extracted triples: repair, pruning by their section's cohort, and data-set access.

Word lists and alias tables belong to a corpus and come as small tables or lists, never from here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The relation that an object's type calls for; fixed values of the schema.
CANONICAL = {
    "Disease": "TARGETS_DISEASE", "Method": "APPLIES_METHOD", "Task": "PERFORMS_TASK", "Tissue": "OPERATES_ON", "Dataset": "USES_DATASET",
    "Metric": "ACHIEVES_METRIC", "Modality": "USES_MODALITY", "Limitation": "REPORTS_LIMITATION",
}
METHOD_RELATIONS = ["APPLIES_METHOD", "COMPARES_METHOD"]
ACCESS = ["unknown", "private", "public"]


def norm_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def with_aliases(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Object names normalised, and replaced by their alias where aliases (type, alias, canonical) has one."""
    a = F.broadcast(aliases.select(F.col("type").alias("_t"), F.col("alias").alias("_a"), "canonical"))  # a dimension table
    keyed = triples.withColumn("object_name", norm_key(F.col("object_name")))
    return keyed.join(a, (F.col("object_type") == F.col("_t")) & (F.col("object_name") == F.col("_a")), "left").withColumn("object_name", F.coalesce("canonical", "object_name")).drop("_t", "_a", "canonical")


def repaired(triples: DataFrame) -> DataFrame:
    """Relations brought in line with their object's type; RELATED_TO stays between methods only."""
    expected = F.coalesce(*[F.when(F.col("object_type") == k, v) for k, v in CANONICAL.items()])
    known = F.col("relation").isin([*CANONICAL.values(), "COMPARES_METHOD"])
    related = F.col("relation") == "RELATED_TO"
    fits = (F.col("relation") == expected) | ((F.col("relation") == "COMPARES_METHOD") & (F.col("object_type") == "Method"))
    fixed = F.when(related, F.when((F.col("subject_type") == "Method") & (F.col("object_type") == "Method"), "RELATED_TO")).when(known & fits, F.col("relation")).when(known, expected)
    return triples.withColumn("relation", fixed).filter("relation IS NOT NULL")


def pruned(triples: DataFrame, generic: list[str], low_value: list[str], radiology: list[str], no_method_sections: list[str]) -> DataFrame:
    """Triples of (pmid, section) without low-value and, beside specific ones, generic methods.

    Methods are dropped in sections that describe no own work; a generic method that stays has a
    confidence of at most 0.5; a disease goes if a longer name in its section holds it; of a method
    that is both applied and compared, the application stays. One aggregate a section, no self-join
    of rows: the section's names travel with its rows as a set.
    """
    key = ["pmid", "section"]
    is_generic, is_low = F.col("object_name").isin(generic), F.col("object_name").isin(low_value)
    method = F.col("relation").isin(METHOD_RELATIONS) & (F.col("object_type") == "Method")
    cohort = triples.groupBy(*key).agg(
        F.max(F.coalesce(method & ~is_generic & ~is_low, F.lit(False))).alias("specific"),
        F.collect_set(F.when(F.col("object_type") == "Disease", F.col("object_name"))).alias("diseases"),
        F.collect_set(F.when((F.col("relation") == "APPLIES_METHOD") & ~is_low & ~F.col("section").isin(no_method_sections), F.col("object_name"))).alias("applied"),
    )
    rows = triples.join(cohort, key)
    wider = F.exists("diseases", lambda d: (d != F.col("object_name")) & (F.length(d) >= F.length("object_name") + 3) & F.contains(d, F.col("object_name")))
    drop = (
        (F.col("relation").isin(METHOD_RELATIONS) & F.col("section").isin(no_method_sections))
        | ((F.col("object_type") == "Method") & is_low)
        | ((F.col("object_type") == "Disease") & wider)
        | ((F.col("object_type") == "Modality") & F.col("object_name").isin(radiology))
        | (method & F.col("specific") & is_generic)
        | ((F.col("relation") == "COMPARES_METHOD") & F.array_contains("applied", F.col("object_name")))
    )
    kept = rows.filter(~F.coalesce(drop, F.lit(False)))
    return kept.withColumn("confidence", F.when(method & is_generic, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))).drop("specific", "diseases", "applied")


def dataset_access(name: Column, quote: Column, hint: Column, public: list[str], private_cues: str) -> Column:
    """public by a listed name within the name, else private by a cue, else the hint, else unknown."""
    key = norm_key(name)
    listed = F.exists(F.array(*[F.lit(p) for p in public]).cast("array<string>"), lambda p: F.contains(F.concat(F.lit(" "), F.regexp_replace(key, "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))
    cue = F.concat_ws(" ", key, F.lower(F.coalesce(quote, F.lit("")))).rlike(private_cues)
    said = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    return F.when(listed, "public").when(cue, "private").when(said.isin(ACCESS), said).otherwise("unknown")


def stronger_access(a: Column, b: Column) -> Column:
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ACCESS)), F.lower(c)), F.lit(0)), F.lit(1))
    return F.element_at(F.array(*map(F.lit, ACCESS)), F.greatest(rank(a), rank(b)).cast("int"))


def body_chars(sections: DataFrame, key: str) -> DataFrame:
    """Characters of each paper's sections besides its abstract and tiny loose ones."""
    size = F.length(F.trim("content"))
    counts = (F.col("section_type") != "abstract") & ~((F.col("section_type") == "other") & (size < 120))
    return sections.groupBy(key).agg(F.coalesce(F.sum(F.when(counts, size)), F.lit(0)).alias("body_chars"))


def non_substantive(papers: DataFrame, sections: DataFrame, key: str, least: int = 800, thin: int = 250) -> DataFrame:
    """Papers with sections whose body is short and whose abstract is thin."""
    short = F.length(F.trim(F.coalesce("abstract", F.lit("")))) <= thin
    return papers.join(body_chars(sections, key), key).filter((F.col("body_chars") < least) & short)
