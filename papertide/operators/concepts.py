"""Disease concepts: aliases that lead to one, and the names that belong to it.

The concepts are a small table that the caller brings, one row a concept: concept_id, canonical, and the
arrays phrases, sites, histology, abbreviations, zh and morphology. It is a list kept by hand, so that it
may be broadcast; its rows are told apart by their order, `place`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPTS = (
    "place int, concept_id string, canonical string, phrases array<string>, sites array<string>, histology array<string>, "
    "abbreviations array<string>, zh array<string>, morphology array<string>"
)


@dataclass(frozen=True)
class Concept:
    concept_id: str
    canonical: str
    phrases: tuple[str, ...] = ()
    sites: tuple[str, ...] = ()
    histology: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    zh: tuple[str, ...] = ()
    morphology: tuple[str, ...] = ()


def table(spark: SparkSession, concepts: Iterable[Concept]) -> DataFrame:
    cells = lambda c: [list(x) if isinstance(x, tuple) else x for x in astuple(c)]
    return spark.createDataFrame([(i, *cells(c)) for i, c in enumerate(concepts)], CONCEPTS)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether a text holds one of the terms, in any case."""
    low = F.lower(text)
    return any_of(F.contains(low, F.lit(t.lower())) for t in terms)


def belongs(text: Column, concept: Concept) -> Column:
    """Whether a name belongs to a concept.

    It does by the canonical name or a phrase; by a site together with a morphology or, for concepts
    without morphologies, a histology; or by an abbreviation that stands between blanks or at either end
    of a longer name, together with a site or a histology, for concepts that have both. Null names don't.
    """
    low, place, tissue = F.lower(text), holds_any(text, concept.sites), holds_any(text, concept.histology)
    named = holds_any(text, [concept.canonical, *concept.phrases])
    if concept.morphology and concept.sites:
        sited = place & holds_any(text, concept.morphology)
    else:
        sited = place & tissue
    short = F.lit(False)
    if concept.sites and concept.histology:
        word = lambda a: F.contains(low, F.lit(f" {a} ")) | F.startswith(low, F.lit(f"{a} ")) | F.endswith(low, F.lit(f" {a}"))
        short = any_of(word(a.lower()) for a in concept.abbreviations) & (place | tissue)
    return F.coalesce(named | sited | short, F.lit(False))


def aliases(concepts: DataFrame) -> DataFrame:
    """(place, concept_id, canonical, alias, kind, rank): every string that can lead to a concept."""
    kinds = (("zh", F.col("zh")), ("phrase", F.col("phrases")), ("canonical", F.array("canonical")), ("abbrev", F.col("abbreviations")))
    of = lambda rank, kind, names: F.transform(names, lambda x: F.struct(x.alias("alias"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))
    every = F.explode(F.concat(*[of(rank, kind, names) for rank, (kind, names) in enumerate(kinds)]))
    return concepts.select("place", "concept_id", "canonical", every.alias("a")).select("place", "concept_id", "canonical", "a.*").filter("alias <> ''")


def resolved(foci: DataFrame, concepts: DataFrame, column: str = "focus") -> DataFrame:
    """foci with concept_id and canonical of the concept that each stands for, null where it stands for none.

    The longest alias wins, then its kind (zh, phrase, canonical, abbreviation), then the table's order. A zh
    alias must stand within the focus; an abbreviation as a word of it; other aliases within it or it within
    them. Foci that repeat stay as they are; blank and null foci stand for nothing.
    """
    names = foci.select(column).distinct()
    raw = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    asked = names.withColumn("_raw", raw).filter("_raw <> ''").withColumn("_low", F.lower("_raw"))
    low = F.lower("alias")
    bounded = F.expr(r"_low RLIKE concat('(?U)\\b', regexp_replace(lower(alias), '([^\\p{L}\\p{N}_ ])', '\\\\$1'), '\\b')")
    meets = (
        F.when(F.col("kind") == "zh", F.contains("_raw", "alias"))
        .when(F.col("kind") == "abbrev", bounded)
        .otherwise(F.contains("_low", low) | F.contains(low, F.col("_low")))
    )
    found = asked.join(F.broadcast(aliases(concepts)), meets)  # the aliases of a list kept by hand
    order = F.struct(F.length("alias"), -F.col("rank"), -F.col("place"))
    best = found.groupBy(column).agg(F.max_by(F.struct("concept_id", "canonical"), order).alias("_best"))
    return foci.join(best, column, "left").select(*foci.columns, "_best.concept_id", "_best.canonical")


def focus_keys(foci: DataFrame, concepts: DataFrame, column: str = "focus") -> DataFrame:
    """foci with focus_key: the concept's canonical name, else the focus in lower case with single blanks;
    `__all__` for blanks and nulls. Keys that are keys already stay."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    known = resolved(foci, concepts, column)
    key = F.coalesce(plain(F.col("canonical")), F.nullif(plain(F.col(column)), F.lit("")), F.lit("__all__"))
    return known.withColumn("focus_key", F.when(F.col(column) == "__all__", "__all__").otherwise(key)).drop("concept_id", "canonical")


def alias_map(concepts: DataFrame, target: str = "canonical") -> DataFrame:
    """(alias, target): every alias in lower case and what it leads to; the later concept wins. Sites are aliases
    of concepts without morphologies."""
    sites = concepts.filter(F.size("morphology") == 0).select("place", F.col(target).alias("target"), F.explode("sites").alias("alias"))
    named = aliases(concepts).select("place", "alias").join(concepts.select("place", F.col(target).alias("target")), "place")
    low = named.unionByName(sites).withColumn("alias", F.lower("alias"))
    return low.groupBy("alias").agg(F.max_by("target", "place").alias("target"))


def expanded(foci: DataFrame, concepts: DataFrame, column: str = "focus") -> DataFrame:
    """foci with all that their concept stands for: concept_id, canonical, phrases (in lower case with the canonical name,
    sorted, without repeats), sites, histology, abbreviations, zh and morphology; null and empty where there is none."""
    known = resolved(foci, concepts, column)
    phrases = F.array_sort(F.array_distinct(F.transform(F.concat(F.array("canonical"), "phrases"), lambda p: F.lower(p))))
    lists = ("sites", "histology", "abbreviations", "zh", "morphology")
    table_ = concepts.groupBy("concept_id").agg(F.min_by(F.struct(phrases.alias("phrases"), *lists), "place").alias("_c"))
    none = F.array().cast("array<string>")
    rows = known.join(table_, "concept_id", "left")
    return rows.select(*foci.columns, "concept_id", "canonical", *[F.coalesce(F.col("_c")[c], none).alias(c) for c in ("phrases", *lists)])
