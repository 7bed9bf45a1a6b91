"""Joins of growing tables by what their strings hold, without meeting all pairs.

`containments` finds which strings stand within which others by the rarest gram of each; `similar_pairs`
finds the pairs whose matching blocks cover enough of both by a prefix of their characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The gram by which strings meet; shorter strings meet by themselves.
GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters that a text holds; none where it is shorter."""
    chars = F.split(text, "")
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(size)), ""))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def containments(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """(text, needle): distinct pairs where the needle stands within the text, as written.

    Every needle is looked up by one gram only, the one that fewest texts hold, so that a pair that has
    only common grams in common never meets. Null and empty strings of either side meet nothing.
    """
    texts = texts.select(F.col(text).alias("_text")).filter("_text <> ''").distinct()
    needles = needles.select(F.col(needle).alias("_needle")).filter("_needle <> ''").distinct()
    size = F.least(F.length("_needle"), F.lit(GRAM))
    sizes = [r[0] for r in needles.select(size.alias("size")).distinct().collect()]  # at most GRAM numbers
    if not sizes:
        return texts.select(F.col("_text").alias(text), F.col("_text").alias(needle)).limit(0)
    every = F.concat(*[F.transform(grams(F.col("_text"), s), lambda g: F.struct(g.alias("gram"))) for s in sizes])
    held = texts.select("_text", F.explode(every).alias("_g")).select("_text", "_g.gram")
    own = F.coalesce(*[F.when(size == s, grams(F.col("_needle"), s)) for s in sizes])
    asked = needles.select("_needle", F.size(own).alias("_grams"), F.explode(own).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "gram").groupBy("_needle", "_grams").agg(F.min(F.struct("n", "gram")).alias("least"), F.count(F.lit(1)).alias("known"))
    rarest = rarest.filter("known = _grams").select("_needle", F.col("least.gram").alias("gram"))  # else no text holds it
    met = held.join(rarest, "gram").filter(F.contains("_text", "_needle"))
    return met.select(F.col("_text").alias(text), F.col("_needle").alias(needle))


def ratios(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the characters in matching blocks, of all characters; 1 for two empty strings."""
    for a, b in parts:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The ratio of two strings in lower case, blocks found from the first string's side; null of null."""
    ratio = pandas_udf(ratios, "double")
    return F.when(a.isNotNull() & b.isNotNull(), ratio(F.coalesce(F.lower(a), F.lit("")), F.coalesce(F.lower(b), F.lit(""))))


def most_similar(a: Column, b: Column) -> Column:
    """What the ratio can be at most: from the characters that both hold, however they stand."""
    a, b = F.lower(a), F.lower(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * shared / (F.length(a) + F.length(b)))


def numbered(text: Column) -> Column:
    """A text's characters, each with the number of its occurrence, so that a multiset becomes a set."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda o: o == c)).cast("string")))


def indels(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the longest common subsequence, of all characters; 1 for two empty strings."""
    for a, b in parts:
        yield pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel(x: str, y: str) -> float:
    """Rows of the subsequence table as bits of one number, a character of y a step."""
    if not x and not y:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


def indel_similarity(a: Column, b: Column) -> Column:
    """The share of characters that insertions and deletions leave; null of null."""
    ratio = pandas_udf(indels, "double")
    return F.when(a.isNotNull() & b.isNotNull(), ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, percent: int, score: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """(a, b, similarity): distinct pairs of strings whose similarity is at least `percent` in a hundred.

    score is a measure of the characters in common, of all characters, such as similarity and
    indel_similarity.

    A pair needs that share of common characters, so that the rarest characters of the one, as many as
    can be missed and one more, hold one of the other's; only pairs that share enough are scored. Null
    and empty strings meet nothing.
    """
    one = left.select(F.col(a).alias("_a")).filter("_a <> ''").distinct()
    other = right.select(F.col(b).alias("_b")).filter("_b <> ''").distinct()
    # with x of the shorter and y of the longer characters, 2 * x / (x + y) >= s bounds what both must share
    least = Fraction(percent, 200 - percent)

    def told(rows: DataFrame, name: str) -> DataFrame:
        low = F.lower(name)
        n = F.length(low)
        spare = n - F.ceil(n * least.numerator / least.denominator - 1e-9) + 1
        return rows.select(name, F.explode(numbered(low)).alias("char"), n.alias(f"{name}_n"), spare.alias("_spare"))

    chars = told(one, "_a").select("_a", "char").unionAll(told(other, "_b").select("_b", "char"))
    often = chars.groupBy("char").agg(F.count(F.lit(1)).alias("n"))

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        ranked = told(rows, name).join(often, "char").groupBy(name, f"{name}_n", "_spare").agg(F.array_sort(F.collect_list(F.struct("n", "char"))).alias("_chars"))
        return ranked.select(name, f"{name}_n", F.explode(F.slice("_chars", F.lit(1), F.col("_spare").cast("int"))).alias("_c")).select(name, f"{name}_n", "_c.char")

    met = prefix(one, "_a").join(prefix(other, "_b"), "char").filter(f"200 * least(_a_n, _b_n) >= {percent} * (_a_n + _b_n)").select("_a", "_b").distinct()
    bound = met.filter(most_similar(F.col("_a"), F.col("_b")) >= percent / 100 - 1e-9)
    scored = bound.select(F.col("_a").alias(a), F.col("_b").alias(b), score(F.col("_a"), F.col("_b")).alias("similarity"))
    return scored.filter(F.col("similarity") >= percent / 100)


def overlapping(left: DataFrame, right: DataFrame, percent: int, by: tuple[str, ...] = ()) -> DataFrame:
    """left (..., a) beside right (..., b), once for each two rows whose token sets a and b can overlap by `percent` of
    all their tokens in a hundred, within equal columns of `by`; an exact test is to follow.

    Such sets share at least that part of the larger one, so that their rarest tokens, as many as can be
    missed and one more, have one in common: no token that all rows hold brings them together. Rows with
    no tokens meet nothing; rows of either side must be distinct.
    """
    by_list = list(by)
    tokens = lambda rows, c: rows.select(*by_list, F.explode(c).alias("_token"))
    often = tokens(left, "a").unionAll(tokens(right, "b")).groupBy(*by_list, "_token").agg(F.count(F.lit(1)).alias("_n"))

    def prefix(rows: DataFrame, c: str) -> DataFrame:
        spare = F.floor(F.size(c) * (100 - percent) / 100 + 1e-9) + 1
        each = rows.select(*rows.columns, F.explode(c).alias("_token")).join(often, [*by_list, "_token"])
        ranked = each.groupBy(*rows.columns).agg(F.array_sort(F.collect_list(F.struct("_n", "_token"))).alias("_ranked"))
        return ranked.select(*rows.columns, F.explode(F.slice("_ranked", F.lit(1), spare.cast("int"))).alias("_r")).select(*rows.columns, "_r._token")

    met = prefix(left, "a").join(prefix(right, "b"), [*by_list, "_token"]).filter(f"100 * least(size(a), size(b)) >= {percent} * greatest(size(a), size(b))")
    return met.drop("_token").distinct()
