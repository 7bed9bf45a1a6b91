"""Quality rules: plain counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over trusted documents
(labelled good and not toxic), one over all documents. A document's score is the mean log-ratio of its
n-grams, whatever its length; every document is held against one threshold, which lies as far below
the scores' lower end as that lies below their middle, among trusted documents that weren't counted.
Where documents labelled bad score lower than that end, it lies at least halfway between the two.
Only DataFrame functions run here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, drop_folder, read_table, settle, shared_dir

#: Counters; trusted documents at most (those of the least id hashes, a bounded sample that may be
#: broadcast); pseudo-counts; scores are in 2**-SCALE_BITS nats.
BUCKETS, TRUSTED, PSEUDO, SCALE_BITS = 32_768, 20_000, 1.0, 20
#: Trusted documents are dealt into four folds by id: counted, counted, for the threshold, held out.
COUNTED, CALIBRATION, HELD_OUT = (0, 1), 2, 3
#: Documents labelled bad are dealt alike: those whose scores place the threshold; the others are held out.
REJECTED = (0, 1)
#: The lower end: the part of trusted documents below it. The upper end of bad ones: the part below it. The threshold where none is left to find one by.
LOWER_END, UPPER_END, UNCALIBRATED = 0.001, 0.84, -0.25
#: Characters that count as symbols, and the base rules' limits; fixed values.
SYMBOLS, MIN_WORDS, REPEAT_PERCENT = "#*$%&|<>", 50, 50
BLANK = " \t\n\x0b\x0c\r"


def counted_words(docs: DataFrame) -> DataFrame:
    """docs with _pt_words, and _pt_one and _pt_two: hashes of its words and of its pairs of neighbours.

    Each step is a column by itself, so that none is worked out twice.
    """
    body, w, one = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANK)), F.col("_pt_words"), F.col("_pt_one")
    docs = docs.withColumn("_pt_words", F.when(body != "", F.split(body, WORD_SPACE)).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_pt_one", F.transform(w, lambda x: F.xxhash64(x)))
    return docs.withColumn("_pt_two", neighbours(one, lambda a, b: F.xxhash64(a, b)))


def neighbours(items: Column, f) -> Column:
    """f of each item and the next one."""
    most = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, most), F.slice(items, 2, most), f)


def bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def weights_of(docs: DataFrame, trusted: DataFrame, folder: str) -> list[int] | None:
    """The log-ratio of each counter, in whole 2**-SCALE_BITS; None without any trusted text.

    All rows of docs are counted, once each; counters that no document has weigh 0.
    """
    counted = trusted.filter(F.col("_pt_fold").isin(*COUNTED)).select("_pt_trusted")
    marked = docs.join(F.broadcast(counted), F.col("doc_id") == F.col("_pt_trusted"), "left")  # TRUSTED rows at most
    grams = counted_words(marked).select(F.col("_pt_trusted").isNotNull().cast("long").alias("good"), F.explode(F.concat("_pt_one", "_pt_two")).alias("gram"))
    counts = settle(grams.groupBy(bucket(F.col("gram")).alias("at")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")), folder, "ngrams")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    if not total["good"]:
        return None
    share = lambda c: (F.col(c) + PSEUDO) / (total[c] + PSEUDO * BUCKETS)
    found = counts.select("at", F.round((F.log(share("good")) - F.log(share("raw"))) * (1 << SCALE_BITS)).cast("long").alias("weight")).collect()  # BUCKETS rows at most
    table = [0] * BUCKETS
    for row in found:
        table[row["at"]] = row["weight"]
    return table


def constant(weights: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<bigint>")


def summed(weights: Column, *grams: str) -> Column:
    """The weights of all n-grams of counted_words, summed."""
    step = lambda total, h: total + F.get(weights, bucket(h))
    return sum((F.aggregate(g, F.lit(0).cast("long"), step) for g in grams), F.lit(0).cast("long"))


def grams_of(words: Column) -> Column:
    return F.greatest(2 * words - 1, F.lit(0))


def dealt(labels: DataFrame, which: str, most: int) -> DataFrame:
    """(_pt_trusted, _pt_fold) of at most so many labelled documents, those of the least id hashes."""
    some = labels.filter(which).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_pt_trusted")).distinct()
    return some.orderBy(F.xxhash64("_pt_trusted"), "_pt_trusted").limit(most).withColumn("_pt_fold", F.pmod(F.xxhash64("_pt_trusted", F.lit("fold")), F.lit(4)))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Documents that are labelled good and not toxic."""
    return dealt(labels, "quality = 1 AND coalesce(toxic, 0) = 0", most)


def rejected_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Documents that are labelled bad, and not good besides."""
    good = labels.filter("quality = 1").select("doc_id")
    return dealt(labels.join(good, "doc_id", "left_anti"), "quality = 0", most)


def scores_of(docs: DataFrame, ids: DataFrame, weights: list[int]) -> DataFrame:
    """(doc_id, good, score): the mean log-ratio of the documents of a bounded table (_pt_trusted, good), in 2**-SCALE_BITS nats."""
    words = counted_words(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_pt_trusted"))).filter(F.size("_pt_words") >= MIN_WORDS)  # 2 * TRUSTED rows at most
    return words.select("doc_id", "good", (summed(constant(weights), "_pt_one", "_pt_two") / grams_of(F.size("_pt_words"))).alias("score"))


def threshold_of(docs: DataFrame, trusted: DataFrame, rejected: DataFrame, weights: list[int]) -> int:
    """The least mean log-ratio, in whole 2**-SCALE_BITS nats, from the scores of the folds kept for it, by one pass.

    From few trusted documents the lower end is uncertain, and so is what lies below it; the bad ones then
    keep the threshold from falling among them.
    """
    ids = trusted.filter(F.col("_pt_fold") == CALIBRATION).select("_pt_trusted", F.lit(True).alias("good")).union(rejected.filter(F.col("_pt_fold").isin(*REJECTED)).select("_pt_trusted", F.lit(False).alias("good")))
    of = lambda good, *parts: F.percentile(F.when(F.col("good") == good, F.col("score")), F.array(*map(F.lit, parts)))
    row = scores_of(docs, ids, weights).agg(of(True, LOWER_END, 0.5).alias("good"), of(False, UPPER_END).alias("bad")).first()
    if row["good"] is None:
        return int(UNCALIBRATED * (1 << SCALE_BITS))
    low, middle = row["good"]
    high = row["bad"][0] if row["bad"] else None
    return int(2 * low - middle if high is None or high >= low else max(2 * low - middle, (low + high) / 2))


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Add the rules' counts and verdicts to docs (doc_id, text); columns of these names are replaced.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr_sum (whole
    2**-20 nats over all n-grams), kept. threshold: the least mean log-ratio in nats, or None to find it
    (see threshold_of). A null, empty or blank text has no words and fails. Repeated rows are counted and
    judged as often as they are there, null doc_ids are never trusted; labels without a document, or
    with null fields, don't matter; without any trusted document the score is 0 and the base rules alone
    decide. Empty tables give an empty result. No row is shuffled; names that begin with _pt_ are reserved.
    """
    folder = shared_dir(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    trusted = settle(trusted_ids(labels), folder, "trusted")
    weights = weights_of(plain, trusted, folder)
    if weights is None:
        least = 0
    else:
        rejected = settle(rejected_ids(labels), folder, "rejected")
        least = threshold_of(plain, trusted, rejected, weights) if threshold is None else int(threshold * (1 << SCALE_BITS))
    drop_folder(docs.sparkSession, folder)
    text = F.coalesce(F.col("text"), F.lit(""))
    w, lines = F.col("_pt_words"), F.col("_pt_lines")
    tri, order, same = F.col("_pt_tri"), F.col("_pt_order"), F.col("_pt_same")
    out = counted_words(docs).withColumn("_pt_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    # 3-word windows, by a hash of their two pairs; too short texts have none
    out = out.withColumn("_pt_tri", neighbours(F.col("_pt_two"), lambda a, b: F.xxhash64(a, b)))
    # texts without a repeated window, found by a hash set, need no sorting
    placed = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_pt_order", F.when(F.size(F.array_distinct(tri)) < F.size(tri), placed))
    out = out.withColumn("_pt_same", F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), same)
    hit = F.zip_with(F.zip_with(order, same, lambda o, s: F.struct(o["i"].alias("i"), s.alias("s"))), before, lambda x, b: F.when(x["s"] | b, x["i"]))
    out = out.withColumn("_pt_starts", F.array_sort(F.filter(hit, lambda i: i.isNotNull())))
    starts = F.col("_pt_starts")
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))).cast("long"))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(text, BLANK, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"),
        "llr_sum": F.lit(0).cast("long") if weights is None else summed(constant(weights), "_pt_one", "_pt_two"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr_sum") >= grams_of(F.col("n_words")) * least))
    return out.drop("_pt_words", "_pt_one", "_pt_two", "_pt_lines", "_pt_tri", "_pt_order", "_pt_same", "_pt_starts")


def held_out_recall(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, toxic, docs, base_kept, kept): verdicts on labelled documents that took no part in the fit.

    Of good ones that is the fold held out, of bad ones those that don't place the threshold; of the
    others, all, since the fit reads none of them.
    """
    fit = trusted_ids(labels).filter(F.col("_pt_fold") != HELD_OUT).union(rejected_ids(labels).filter(F.col("_pt_fold").isin(*REJECTED))).select("_pt_trusted")
    judged = with_quality(docs.select("doc_id", "text"), labels).join(F.broadcast(fit), F.col("doc_id") == F.col("_pt_trusted"), "left_anti")
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    tally = judged.join(marks, "doc_id").groupBy("quality", "toxic")
    return tally.agg(F.count(F.lit(1)).alias("docs"), F.sum((~F.col("base_failed")).cast("long")).alias("base_kept"), F.sum(F.col("kept").cast("long")).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns.

    The row number in the condition keeps the optimizer from moving it below the steps that make the
    verdict, where each of them would be worked out anew wherever the condition names it.
    """
    judged = with_quality(docs, labels).withColumn("_pt_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_pt_row") >= 0)).select(docs.columns)


def op10_ngram_llr_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = with_quality(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_sum")
