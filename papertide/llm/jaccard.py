"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word 5-grams; two link when 100 * |A & B| >= 80 * |A | B|.
All sets are sorted alike, by how many documents hold a token, rarest first. A link needs an overlap
of o tokens, so the first |A| - o + l tokens of A share at least l tokens with the first |B| - o + l
of B. Each document picks how far to lengthen its prefix by the cost of the candidates that it would
draw, and a pair must share correspondingly many prefix tokens before its sets are compared. Only
then are components built from the verified links.

The order needs counts of all documents. Prefixes of a hash order come from its lowest part, so the
tokens of that part (LOW of all) are counted exactly; those above it by a sketch of fixed size, which
matters only to documents that consist of crowded tokens for the most part. As crowded tokens come
last, a document that merely holds a passage of many others has none of them in its prefix.

The smaller document of a pair needs a ninth of its tokens as a prefix, the larger one a fifth, and a
shared token counts only where it stands early enough in both for an overlap of o. Every document of
a crowded token is first compared with one hub, the most typical document of it, and what links is
merged, again and again while that links many; pairs within one component are never listed, for they
can add nothing to it, and a token's largest component meets only the others. Two documents of one
hub overlap by at most the lesser of their overlaps with the hub plus the tokens that they share
besides it. So they meet only by those tokens, which are few and rare, and by the few pairs that need
none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, join_few, read_table, settle, shared_dir, sized

WORDS, PERCENT = 5, 80
#: The part of the hash order that is counted exactly; counters of the sketch for the rest; crowded
#: tokens that are told to all tasks (beyond so many, only the most crowded); how far a prefix may be
#: lengthened; the cost of comparing two sets, in postings read; documents that make a token crowded.
LOW, SKETCH, TOLD, LENGTHEN, COMPARE, CROWDED = 0.3, 1 << 18, 2_000_000, (0, 1, 3, 7, 15), 8, 16
LEAST_HIGH = np.uint64(int(LOW * 2**64))
#: Rows of a table of ids that may be broadcast (of 16 to 32 bytes each).
BROADCAST_ROWS = 500_000
#: Word hashes that a Python worker keeps, and sets whose prefix it has told already; rows that it holds as Python objects
#: at once, whatever the size of the batches that Spark sends.
KEEP, STEP = 400_000, 256

#: Odd factors that set the words of a shingle apart by their place.
PLACES = [np.uint64(int(xxhash.xxh64_intdigest(f"place {i}")) | 1) for i in range(WORDS)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEEP:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads sums of products over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stepwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most STEP rows, so that neither what is read nor what is told is held for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; with fewer words, of the whole sequence as one."""
    words = text.encode().lower().split() if text else []  # on bytes, both treat ASCII alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(codes) < WORDS:
        total = sum((codes[i : i + 1] * PLACES[i] for i in range(len(codes))), np.uint64(len(codes)))
        return mixed(total)
    n = len(codes) - WORDS + 1
    return np.unique(mixed(sum((codes[i : n + i] * PLACES[i] for i in range(1, WORDS)), codes[:n] * PLACES[0])))


class Crowds:
    """How many documents hold a token, as far as it is crowded, else 0; the same for all tasks."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, sketch: np.ndarray):
        self.tokens, self.counts, self.sketch = tokens, counts, sketch

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of sorted tokens."""
        out = np.zeros(len(tokens), dtype=np.float32)
        low = int(np.searchsorted(tokens, LEAST_HIGH))
        if len(self.tokens) and low:
            at = np.minimum(np.searchsorted(self.tokens, tokens[:low]), len(self.tokens) - 1)
            out[:low] = np.where(self.tokens[at] == tokens[:low], self.counts[at], 0)
        out[low:] = self.sketch[(tokens[low:] % np.uint64(SKETCH)).astype(np.int64)]
        return out


def crowds_of(docs: DataFrame, folder: str, told: int = TOLD) -> Crowds:
    """Counts of the crowded tokens of all rows of docs.

    Of the lower tokens every one is counted, and the counts are told to all tasks from CROWDED up, or
    from the least power of two that leaves at most `told` of them. Counters of the sketch are told as
    what they hold beyond chance.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, high = WordHashes(), np.zeros(SKETCH, dtype=np.int64)
        row = lambda tokens, n: pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(n)], ["token", "n"])
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, hashes))
                size += len(held[-1])
                if size > 500_000:
                    yield row(*split(held, high))
                    held, size = [], 0
            if held:
                yield row(*split(held, high))
        at = np.flatnonzero(high)
        yield row(-1 - at, high[at])

    def split(held: list[np.ndarray], high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.concatenate(held)
        is_low = tokens < LEAST_HIGH
        high += np.bincount((tokens[~is_low] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        low = tokens[is_low]
        return low, np.ones(len(low), dtype=np.int64)

    counts = docs.select("text").mapInArrow(emit, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(f"token < 0 OR n >= {CROWDED}")
    counts = settle(counts, folder, "crowds")
    sizes = {r["bits"]: r["tokens"] for r in counts.filter("token >= 0").groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count(F.lit(1)).alias("tokens")).collect()}  # a row for each power of two
    least = CROWDED
    while sum(tokens for bits, tokens in sizes.items() if 1 << bits >= least) > told:
        least *= 2
    found = counts.filter(f"token < 0 OR n >= {least}").toPandas()  # SKETCH + told rows at most
    upper, lower = found[found["token"] < 0], found[found["token"] >= 0].sort_values("token")
    sketch = np.zeros(SKETCH)
    sketch[-1 - upper["token"].to_numpy()] = upper["n"]
    usual = np.median(sketch)
    beyond = np.maximum(0.0, sketch - usual - 4 * np.sqrt(usual))
    return Crowds(lower["token"].to_numpy().astype(np.uint64), lower["n"].to_numpy(dtype=np.float32), np.where(beyond >= CROWDED, beyond, 0).astype(np.float32))


def prefix_of(tokens: np.ndarray, crowds: Crowds) -> tuple[np.ndarray, int]:
    """The lengthened prefix, and by how many tokens: rarest tokens first, ties by hash, as everywhere."""
    n = len(tokens)
    often = crowds.of(tokens)
    order = np.argsort(np.floor(np.log2(1 + often)), kind="stable")
    least = n - ceil(Fraction(PERCENT * n, 100)) + 1
    drawn = np.cumsum(often[order])
    costs = [drawn[min(n, least + more) - 1] * (1 + COMPARE / (1 + more)) for more in LENGTHEN]
    more = LENGTHEN[int(np.argmin(costs))]
    return tokens[order[: min(n, least + more)]], more


def described(docs: DataFrame, crowds: Crowds) -> DataFrame:
    """(doc_id, digest, n, sig, more, prefix) of every row; (n, sig) stands for the set, digest for the text.

    A task tells the prefix of a set once, as long as it remembers it; for later copies it is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crowds)  # SKETCH + TOLD numbers at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = WordHashes(), set()
        for batch in stepwise(batches):
            out = []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, hashes)
                sig = int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))
                if not len(tokens) or sig in told:
                    out.append((len(tokens), sig, 0, None))
                    continue
                if len(told) > KEEP:
                    told.clear()
                told.add(sig)
                prefix, more = prefix_of(tokens, shared.value)
                out.append((len(tokens), sig, more, prefix.astype(np.int64)))
            n, sig, more, prefix = zip(*out, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(more, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *made], ["doc_id", "digest", "n", "sig", "more", "prefix"])

    return docs.select("doc_id", "digest", "text").mapInArrow(describe, "doc_id long, digest long, n long, sig long, more int, prefix array<long>")


def with_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """pairs (a, b) with their sets x and y, as sorted tokens in bytes.

    Sets are made anew from the texts of one document of each class that has a pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", F.col("rep.doc_id").alias("d"), F.col("rep.digest").alias("g"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in stepwise(batches):
            tokens = [shingles(text, hashes).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(tokens, pa.binary())], ["cid", "tokens"])

    few = sized(settle(wanted, folder, "wanted"), BROADCAST_ROWS)
    chosen = docs.join(few, F.expr("digest = g AND doc_id <=> d")).select("cid", "text")
    tokens = settle(chosen.mapInArrow(sets, "cid long, tokens binary"), folder, "sets").dropDuplicates(["cid"])
    return pairs.select("a", "b").join(tokens.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Those (a, b) of pairs whose sets link, found by comparing the whole sets."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepwise(batches):
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    held = shared_dir(docs.sparkSession)
    links = settle(with_sets(pairs, docs, classes, held).mapInArrow(linked, "a long, b long"), folder, "links")
    drop_folder(docs.sparkSession, held)
    return links


def around_hubs(pairs: DataFrame, docs: DataFrame, classes: DataFrame, folder: str, name: str) -> DataFrame:
    """(cid, hub, held, linked, rest) of pairs (a: hub, b: cid): the overlap and what cid has besides it.

    Of pairs that overlap by less than half of cid's set the hub says little; they are left out.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("hub", pa.int64()), ("held", pa.int64()), ("linked", pa.bool_()), ("rest", pa.list_(pa.int64()))])
        for batch in stepwise(batches):
            rows = []
            for hub, cid, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "x", "y")], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                rest = np.setdiff1d(y, x, assume_unique=True)
                held = len(y) - len(rest)
                if 2 * held >= len(y):
                    rows.append((cid, hub, held, 100 * held >= PERCENT * (len(x) + len(rest)), rest.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema)

    sets = shared_dir(docs.sparkSession)
    found = with_sets(pairs, docs, classes, sets).mapInArrow(facts, "cid long, hub long, held long, linked boolean, rest array<long>")
    found = settle(found, folder, name)
    drop_folder(docs.sparkSession, sets)
    return found


def merged(components: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """Components (cid, comp) after links (a, b) between cids: each component is named by its least cid.

    Every component with a smaller neighbour points to the least one; pointers are then followed by
    doubling, and the links between what remains are merged in the same way until there are none.
    """
    step = 0
    edges = links.select("a", "b")
    while True:
        of = lambda c: components.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"))
        between = edges.join(of("a"), "a").join(of("b"), "b").filter("comp_a <> comp_b")
        pointers = settle(between.groupBy(F.greatest("comp_a", "comp_b").alias("node")).agg(F.min(F.least("comp_a", "comp_b")).alias("to")), folder, f"{name}_pointers{step}")
        if pointers.isEmpty():
            return components
        while True:
            step += 1
            onward = settle(pointers.select(F.col("node").alias("to"), F.col("to").alias("further")), folder, f"{name}_onward{step}")
            doubled = join_few(pointers, onward, "to", BROADCAST_ROWS).select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            doubled = settle(doubled, folder, f"{name}_pointers{step}")
            pointers = doubled.select("node", "to")
            if doubled.filter("moved").isEmpty():
                break
        step += 1
        renamed = join_few(components, pointers.withColumnRenamed("node", "comp"), "comp", BROADCAST_ROWS).select("cid", F.coalesce("to", "comp").alias("comp"))
        components = settle(renamed, folder, f"{name}{step}")


#: Of two sets of n and m tokens: whether their sizes allow a link, and the least overlap of one.
NEAR, NEED = f"100 * least(n, m) >= {PERCENT} * greatest(n, m)", f"(({PERCENT} * (n + m) + {99 + PERCENT}) div {100 + PERCENT})"
#: Size classes a tenth apart.
CLASS = "CAST(floor(ln({}) / ln(1.1D)) AS INT)"


def around_leaders(crowded: DataFrame, docs: DataFrame, classes: DataFrame, components: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Facts of around_hubs for the documents of crowded postings, and the components after their links.

    Each round compares every document without a linked hub with the leader that it shares most
    tokens with, and goes on while a round links a tenth of what it compares. Facts are those of a
    document's linked hub, or of its first one.
    """
    known, number = None, 0
    while True:
        typical = crowded.groupBy("cid", "n", "p").agg(F.count(F.lit(1)).alias("k")).select("cid", F.struct((F.col("k") / F.col("p")).alias("share"), "cid", F.col("n").alias("m")).alias("rank"))
        leaders = crowded.join(typical, "cid").groupBy("token").agg(F.max("rank").alias("rank")).select("token", F.col("rank.cid").alias("lead"), F.col("rank.m").alias("m"))
        drawn = crowded.join(leaders, "token").filter("cid <> lead").filter(NEAR).groupBy("cid", "lead").agg(F.count(F.lit(1)).alias("times"))
        best = settle(drawn.groupBy("cid").agg(F.max(F.struct("times", "lead")).alias("best")).select(F.col("best.lead").alias("a"), F.col("cid").alias("b")), folder, f"best{number}")
        hubs = around_hubs(best.join(best.select(F.col("a").alias("b")).distinct(), "b", "left_anti"), docs, classes, folder, f"hubs{number}")  # a hub has no hub besides itself
        linked = hubs.filter("linked")
        components = merged(components, linked.select(F.col("hub").alias("a"), F.col("cid").alias("b")), folder, f"around{number}")
        if known is None:
            known = hubs
        else:
            known = known.join(linked.select("cid"), "cid", "left_anti").unionByName(hubs.join(known.select("cid"), "cid", "left_anti").unionByName(linked.join(known.select("cid"), "cid", "left_semi")))
        known = settle(known, folder, f"known{number}")
        links, tried = linked.count(), hubs.count()
        if 10 * links < max(tried, 10 * CROWDED):
            return known, components
        done = linked.select("cid").union(hubs.select("hub")).distinct()
        crowded = settle(crowded.join(done, "cid", "left_anti"), folder, f"crowded{number}")
        number += 1


def classes_and_components(docs: DataFrame, rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Classes (cid, n, sig, rep) that share a prefix token with another class, and their components (cid, comp)."""
    places = rows.filter("prefix IS NOT NULL").select("n", "sig", "more", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
    twice = places.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token").hint("merge")  # grows with the corpus
    several = places.join(twice, "token").distinct()  # copies of one set count once
    several = settle(several, folder, "several")
    crowd = several.groupBy("token").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    kept = several.join(crowd, "token")
    reps = rows.filter("n > 0").groupBy("n", "sig").agg(F.min(F.struct("doc_id", "digest")).alias("rep"))
    named = kept.select("n", "sig").distinct().join(reps, ["n", "sig"]).withColumn("cid", F.monotonically_increasing_id())
    classes = settle(named, folder, "classes")
    postings = settle(kept.join(classes.select("n", "sig", "cid"), ["n", "sig"]).select("token", "cid", "n", "p", "more", "pos", "crowd"), folder, "postings")
    components = settle(classes.select("cid", F.col("cid").alias("comp")), folder, "components")
    crowded = postings.filter(F.col("crowd") >= CROWDED).select("token", "cid", "n", "p")
    hubs, components = around_leaders(crowded, docs, classes, components, folder)

    facts = classes.select("cid", "n").join(components, "cid").join(hubs.select("cid", "hub", "held", "linked"), "cid", "left")
    facts = settle(facts.withColumns({"hub": F.coalesce("hub", "cid"), "held": F.coalesce("held", "n")}), folder, "facts")
    pairs = [by_prefix(postings, facts, folder), by_rest(hubs, facts, folder), by_size(facts)]
    ends = [df.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")) for df in pairs]
    links = compared(settle(ends[0].union(ends[1]).union(ends[2]).distinct(), folder, "pairs"), docs, classes, folder)
    return classes, merged(components, links, folder, "all")


def renamed(df: DataFrame) -> DataFrame:
    names = {"cid": "other", "n": "m", "more": "more2", "pos": "pos2", "comp": "comp2", "hub": "hub2", "held": "held2"}
    return df.withColumnsRenamed(names)


def by_prefix(postings: DataFrame, facts: DataFrame, folder: str) -> DataFrame:
    """(cid, other) of different hubs and components that share enough prefix tokens, early enough in both.

    Of n <= m tokens, with prefixes lengthened by k at least, one of the pair's overlaps of o has 1 + k
    tokens among the first n - o + 1 + k and m - o + 1 + k. A token's postings in its largest component
    meet only the others, so that a component in which nearly all of them are isn't listed.
    """
    held = settle(postings.join(facts.select("cid", "comp", "hub"), "cid").select("token", "cid", "n", "more", "pos", "comp", "hub"), folder, "held")
    sizes = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    apart = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp")).alias("main")).filter("comps > 1").select("token", F.col("main.comp").alias("main"))
    apart = settle(apart, folder, "apart")  # by itself, so that a join of a crowded token can be split
    left = settle(held.join(apart, "token").withColumn("inside", F.expr("comp = main")).drop("main"), folder, "left")
    # 0: inside with outside, 1: outside with inside, 2: outside with outside
    small = left.filter(f"pos <= n - ({PERCENT} * 2 * n + {99 + PERCENT}) div {100 + PERCENT} + more").withColumn("side", F.explode(F.expr("IF(inside, array(0), array(1, 2))"))).drop("inside")
    large = renamed(left).withColumn("side", F.explode(F.expr("IF(inside, array(1), array(0, 2))"))).drop("inside")
    more = f"least(more, more2, {NEED} - 1)"  # a pair can't be asked to share more tokens than a link does
    early = f"pos <= n - {NEED} + {more} AND pos2 <= m - {NEED} + {more}"
    met = small.join(large, ["token", "side"]).filter(f"(n < m OR n = m AND cid < other) AND comp <> comp2 AND hub <> hub2 AND {NEAR} AND {early}")
    return met.groupBy("cid", "other", F.expr(more).alias("k")).agg(F.count(F.lit(1)).alias("times")).filter("times > k")


def by_rest(hubs: DataFrame, facts: DataFrame, folder: str) -> DataFrame:
    """(cid, other) of one hub: an overlap is at most the lesser part of the hub and what else is shared."""
    rest = hubs.select("cid", F.explode("rest").alias("token")).join(facts.select("cid", "n", "comp", "hub", "held"), "cid")
    apart = rest.groupBy("token", "hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token", "hub")
    left = rest.join(settle(apart, folder, "rest_apart"), ["token", "hub"])
    right = left.select("token", "hub", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("comp").alias("comp2"), F.col("held").alias("held2"))
    met = left.join(right, ["token", "hub"]).filter("cid < other AND comp <> comp2").filter(NEAR)
    return met.groupBy("cid", "other", "n", "m", "held", "held2").agg(F.count(F.lit(1)).alias("times")).filter(f"least(held, held2) + times >= {NEED}")


def by_size(facts: DataFrame) -> DataFrame:
    """(cid, other) of one hub that may share nothing else: only a document short of its hub that would do
    for a smaller one, which is in a size class between the least for a link and the most that its part
    of the hub allows."""
    members = facts.filter("cid <> hub")
    short = members.filter("NOT linked").withColumn("most", F.expr(f"({100 + PERCENT} * held) div {PERCENT} - n")).filter(f"100 * most >= {PERCENT} * n")
    short = short.withColumn("size", F.explode(F.expr(f"sequence({CLASS.format(f'greatest(1, {PERCENT} * n div 100)')}, {CLASS.format('most')})")))
    others = members.select("hub", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("comp").alias("comp2"), F.col("held").alias("held2")).withColumn("size", F.expr(CLASS.format("m")))
    return short.join(others, ["hub", "size"]).filter(f"comp <> comp2 AND {NEAR} AND least(held, held2) >= {NEED}")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, member_of) of every row of docs (doc_id, text).

    Words are runs of anything but ASCII white space after lower-casing A-Z. A null, empty or blank
    text has no shingles and links with nothing, so that its component is its own doc_id. Repeated
    rows and copies share their class and stay apart as rows. Of null doc_ids, the component is the
    least other doc_id reachable, or null; member_of names the component of every document with
    shingles, whatever its ids, and is null for the others. An empty table gives an empty result; other
    columns of docs aren't read, however named. digest is a hash of the text, by which rows that share
    a doc_id are told apart. All that was written on the way is removed, but for the result.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = settle(described(docs, crowds_of(docs, folder)), folder, "rows")
    classes, components = classes_and_components(docs, rows, folder)
    sets = rows.filter("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("least"))
    placed = sets.join(classes.join(components, "cid").select("n", "sig", "comp"), ["n", "sig"], "left")
    placed = settle(placed, folder, "placed")
    joined = settle(placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("component_id")), folder, "joined")
    together = join_few(placed.filter("comp IS NOT NULL"), joined, "comp", BROADCAST_ROWS).select("n", "sig", "component_id", F.concat(F.lit("c"), "comp").alias("member_of"))
    alone = placed.filter("comp IS NULL").select("n", "sig", F.col("least").alias("component_id"), F.concat_ws(":", "n", "sig").alias("member_of"))
    out = (
        rows.select("doc_id", "digest", "n", "sig")
        .join(together.union(alone), ["n", "sig"], "left")
        .select("doc_id", "digest", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "member_of")
    )
    out = settle(out, shared_dir(spark), "components")
    drop_folder(spark, folder)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least (doc_id, text hash), null ids last.

    Documents without shingles (null, empty and blank texts) all stay, repeated ones too. Of repeated
    rows of a component's first document one stays, whichever. Documents with null doc_ids are told
    apart by their texts: only those in one component are copies of each other. An empty table gives
    an empty result; other columns stay as they are, and names that begin with _pt_ are reserved.
    """
    found = jaccard_components(docs)
    folder = shared_dir(docs.sparkSession)
    some = found.filter("n_shingles > 0").select(F.col("doc_id").alias("_pt_d"), F.col("digest").alias("_pt_g"), "member_of")
    first = some.groupBy("member_of").agg(F.min(F.struct(F.col("_pt_d").isNull(), "_pt_d", "_pt_g")).alias("first")).select(F.col("first._pt_d").alias("f"), F.col("first._pt_g").alias("g"))
    first = settle(first, folder, "first")
    rows = some.groupBy("_pt_d", "_pt_g").agg(F.count(F.lit(1)).alias("_pt_rows"))  # (doc_id, digest) lies in one component
    is_first = F.expr("_pt_g = g AND _pt_d <=> f")
    lost = sized(settle(rows.join(first, is_first, "left_anti").select("_pt_d", "_pt_g"), folder, "lost"), BROADCAST_ROWS)
    again = sized(settle(rows.filter("_pt_rows > 1").join(first, is_first, "left_semi").select("_pt_d", "_pt_g"), folder, "again"), BROADCAST_ROWS)
    marked = docs.withColumn("_pt_digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.expr("_pt_digest = _pt_g AND doc_id <=> _pt_d")
    stays = marked.join(lost, same, "left_anti")
    repeated = stays.join(again, same, "left_semi").dropDuplicates(["doc_id", "_pt_digest"])
    return stays.join(again, same, "left_anti").unionByName(repeated).drop("_pt_digest")


def op1_adaptive_prefix_jaccard(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 180 * c >= 80 * (nx.n + ny.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (
    SELECT doc_id, doc_id AS root FROM n
    UNION
    SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id AND e.y > r.root
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
