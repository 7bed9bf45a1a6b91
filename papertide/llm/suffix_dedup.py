"""Removal of passages that stand in an earlier document, by a distributed, sampled suffix array.

Texts that are equal as a whole enter once, under their least doc_id. A string of SPAN bytes that
stands in two texts holds, in both, the same anchor: the least of the hashes of its GRAM-byte pieces.
Only the stretches around anchors of two texts can repeat; they are cut out and packed into blocks of
some hundred kilobytes, those of the same least anchor together, so that most copies of a passage lie in
one block. Of strings of SPAN bytes that stand in a block several times only those of its least doc_id stay
in it, the others are marked at once. Of what stays a sampled suffix array is made (a sparse one: suffixes start at
anchors only, about every tenth byte):

* A block tells the part of the suffixes' order (ranges of GRAM-byte prefixes, from a sample) each distinct suffix, by
  its first SPAN bytes and the LEFT bytes before it, and its least doc_id.
* The part sorts its suffixes, and also what stands before them, nearest byte first. A string of SPAN bytes that starts
  d bytes before its anchor is repeated where suffixes agree in SPAN - d bytes, which makes them neighbours in the one
  order, and in d bytes before them, which makes them neighbours in the other. Bytes are compared, not hashes.
* It answers, for each suffix and d, whether a document of smaller doc_id has that string too. Every string of SPAN
  bytes has an anchor at most LEFT bytes behind its start, so no string is left out.

Sorting is global, and a block's answers come back in the order in which it told, so that places never travel. Parts
are worked off in rounds, one shuffle at a time, each of about as many bytes as the texts have at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, read_table, settle, shared_dir

SPAN, GRAM = 50, 32
#: Grams in a string of SPAN bytes.
WINDOW = SPAN - GRAM + 1
#: The farthest start of such a string before its anchor.
LEFT = WINDOW - 1
#: Bytes of texts in a bundle, anchors and sampled suffixes of a part, least parts of a round.
BUNDLE, ANCHORS, SUFFIXES, ROUND_PARTS = 2_000_000, 3_000_000, 300_000, 16
#: Bytes of stretches of one least anchor that make a block; more are dealt over several.
CLUSTER = 4_000_000
#: The byte between stretches, which no text holds.
END = 0xFF
#: Columns of a told suffix: SPAN bytes from it on, LEFT before it, what is left of both, the least doc_id.
KINDS = [*[np.uint64] * 6, *[np.uint64] * 2, np.uint32, np.int64]
#: Anchors whose bytes are laid out at once.
CHUNK = 100_000
#: Grams of a block, and blocks, that the driver takes the parts' borders from.
SAMPLE, SAMPLE_BLOCKS = 64, 4096
#: The place of null ids: behind all others.
LAST = 2**63 - 1

FACTOR = 0x9E3779B97F4A7C15
CODES = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)


def power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 2**64))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, from those of powers of two."""
    codes, length, out, done = CODES[data], 1, None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = codes, length
            else:
                n = len(data) - done - length + 1
                out = out[:n] * power(length) + codes[done : done + n]
                done += length
        size >>= 1
        if size:
            codes = codes[: len(codes) - length] * power(length) + codes[length:]
            length *= 2
    out = (out ^ (out >> np.uint64(32))) * np.uint64(FACTOR)
    return out ^ (out >> np.uint64(29))


def extremes(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """The extreme of every window of `size` values."""
    n, length = len(values) - size + 1, 1
    while 2 * length <= size:
        values = of(values[:-length], values[length:])
        length *= 2
    return of(values[:n], values[size - length : size - length + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some SPAN bytes around them."""
    hashes = grams(data, GRAM)
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    least = extremes(hashes, WINDOW, np.minimum)
    at = np.flatnonzero(extremes(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == hashes)
    return at, hashes[at]


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (digest, least, text) in bundles: their ends within one body of bytes."""
    schema = pa.schema([("block", pa.int64()), ("digest", pa.list_(pa.binary())), ("least", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("body", pa.binary())])
    base, number = TaskContext.get().partitionId() << 32, 0
    digests, least, parts, size = [], [], [], 0

    def bundle() -> pa.RecordBatch:
        ends = np.cumsum([len(p) for p in parts])
        return pa.RecordBatch.from_pylist([{"block": base + number, "digest": digests, "least": least, "ends": ends.tolist(), "body": b"".join(parts)}], schema)

    for batch in batches:
        for digest, first, text in zip(batch.column("digest"), batch.column("least"), batch.column("text"), strict=True):
            digests.append(digest.as_py())
            least.append(first.as_py())
            parts.append(text.as_py().encode())
            size += len(parts[-1])
            if size >= BUNDLE:
                yield bundle()
                digests, least, parts, size, number = [], [], [], 0, number + 1
    if parts:
        yield bundle()


def bundle_anchors(body: bytes, ends: list[int], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """The distinct anchors of each text of a bundle, by part: hashes, parts, and how to find a text's own again."""
    data, start, own, found = np.frombuffer(body, dtype=np.uint8), 0, [], []
    total = 0
    for end in ends:
        at, hashes = anchors(data[start:end])
        values, inverse = np.unique(hashes, return_inverse=True)
        own.append((start, end, at, total + inverse))
        found.append(values)
        total += len(values)
        start = end
    hashes = np.concatenate(found)
    part = ((hashes >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return hashes[order].astype(np.uint32), part[order], order, own


def slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted parts."""
    borders = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(borders, [*borders[1:], len(part)], strict=True):
        yield int(part[a]), int(a), int(b)


TOLD = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ANSWER = "part long, block long, data binary"


def tell_anchors(parts: int) -> Callable:
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                values, part, _, _ = bundle_anchors(one["body"], one["ends"], parts)
                yield pa.RecordBatch.from_pylist([{"part": p, "block": one["block"], "data": values[a:b].tobytes()} for p, a, b in slices(part)], TOLD)

    return tell


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each bundle's anchors of a part, which of them another text has too, as bits."""
    told = [np.frombuffer(d.as_buffer(), dtype=np.uint32) for d in table.column("data")]
    values = np.concatenate(told)
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    flags = np.empty(len(values), dtype=bool)
    flags[order] = np.append(same, False) | np.append(False, same)
    bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum([len(t) for t in told])[:-1])]
    return pa.table([table.column("part"), table.column("block"), pa.array(bits, pa.binary())], schema=TOLD)


CUT = "cluster long, bundle long, digest array<binary>, least array<long>, owner array<long>, start array<long>, length array<long>, body binary"
BLOCK = "block long, digest array<binary>, least array<long>, owner array<long>, start array<long>, length array<long>, body binary, marks array<binary>"
LISTS = [("digest", pa.list_(pa.binary())), ("least", pa.list_(pa.int64())), ("owner", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("body", pa.binary())]


def stretches(parts: int, clusters: int) -> Callable:
    """The stretches of a bundle's texts that can hold repeated strings, dealt by their least anchors."""
    schema = pa.schema([("cluster", pa.int64()), ("bundle", pa.int64()), *LISTS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                values, part, order, own = bundle_anchors(one["body"], one["ends"], parts)
                bits = {a["part"]: a["data"] for a in one["answers"]}
                flags, hashes = np.empty(len(values), dtype=bool), np.empty(len(values), dtype=np.uint32)
                hashes[order] = values
                for p, a, b in slices(part):
                    flags[order[a:b]] = np.unpackbits(np.frombuffer(bits[p], dtype=np.uint8), count=b - a).astype(bool)
                found: dict[int, dict] = {}
                for text, (begin, end, at, inverse) in enumerate(own):
                    at, known = at[flags[inverse]], hashes[inverse[flags[inverse]]]
                    if not len(at):
                        continue
                    lows, highs = np.maximum(at - WINDOW + 1, 0), np.minimum(at + SPAN, end - begin)
                    apart = np.flatnonzero(lows[1:] > highs[:-1])  # both rise with at
                    first = np.append(0, apart + 1)
                    of = (np.minimum.reduceat(known, first) % np.uint32(clusters)).tolist()
                    for cluster, low, high in zip(of, lows[first].tolist(), highs[np.append(apart, len(at) - 1)].tolist(), strict=True):
                        out = found.setdefault(cluster, {"cluster": cluster, "bundle": one["block"], "texts": [], "owner": [], "start": [], "length": [], "body": []})
                        if not out["texts"] or out["texts"][-1] != text:
                            out["texts"].append(text)
                        out["owner"].append(len(out["texts"]) - 1)
                        out["start"].append(low)
                        out["length"].append(high - low)
                        out["body"].append(one["body"][begin + low : begin + high] + bytes([END]))
                if found:
                    yield pa.RecordBatch.from_pylist([
                        out | {"digest": [one["digest"][i] for i in out["texts"]], "least": [one["least"][i] for i in out["texts"]], "body": b"".join(out["body"])} for out in found.values()
                    ], schema)

    return cut


def joined(places: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of those rising places of the same owner whose strings of SPAN bytes touch."""
    apart = np.flatnonzero((places[1:] > places[:-1] + SPAN) | (of[1:] != of[:-1]))
    return np.append(0, apart + 1), np.append(apart, len(places) - 1)


def collapsed(table: pa.Table) -> pa.Table:
    """One block of a cluster's stretches without the strings that it has of a lesser document too, which are marked."""
    rows = table.to_pylist()
    digest, least = [d for r in rows for d in r["digest"]], np.array([x for r in rows for x in r["least"]])
    before = np.cumsum([0, *[len(r["digest"]) for r in rows]])
    owner = np.concatenate([np.array(r["owner"]) + n for r, n in zip(rows, before[:-1], strict=True)])
    start, length = np.array([x for r in rows for x in r["start"]]), np.array([x for r in rows for x in r["length"]])
    body = b"".join(r["body"] for r in rows)
    begin, count = np.cumsum(length + 1) - length - 1, length - SPAN + 1
    stretch = np.repeat(np.arange(len(length)), count)
    at = np.arange(len(stretch)) + np.repeat(begin - np.cumsum(count) + count, count)
    strings, own = grams(np.frombuffer(body, dtype=np.uint8), SPAN)[at], least[owner[stretch]]
    order = np.argsort(strings)
    new = np.append(True, strings[order][1:] != strings[order][:-1])
    later = np.empty(len(order), dtype=bool)
    later[order] = own[order] > np.minimum.reduceat(own[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    place = at + (start - begin)[stretch]
    marks = [b""] * len(digest)
    gone = np.flatnonzero(later)
    if len(gone):
        a, b = joined(place[gone], owner[stretch[gone]])
        runs, of = np.stack([place[gone[a]], place[gone[b]] + SPAN], axis=1).astype(np.int64), owner[stretch[gone[a]]]
        for text in np.unique(of).tolist():
            marks[text] = runs[of == text].tobytes()
    kept = np.flatnonzero(~later)
    a, b = joined(at[kept], stretch[kept])
    a, b = kept[a], kept[b]
    pieces = [body[x:y] + bytes([END]) for x, y in zip(at[a].tolist(), (at[b] + SPAN).tolist(), strict=True)]
    one = {
        "block": rows[0]["cluster"] << 32 | rows[0]["salt"], "digest": digest, "least": least.tolist(), "owner": owner[stretch[a]].tolist(), "start": place[a].tolist(),
        "length": (at[b] + SPAN - at[a]).tolist(), "body": b"".join(pieces), "marks": marks,
    }
    return pa.Table.from_pylist([one], pa.schema([("block", pa.int64()), *LISTS, ("marks", pa.list_(pa.binary()))]))


def blocks_of(cut: DataFrame) -> DataFrame:
    """Blocks of written stretches; clusters of more than CLUSTER bytes are dealt over several by bundle."""
    sizes = cut.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("body")) / CLUSTER).alias("salts")).filter("salts > 1")
    dealt = cut.join(sizes, "cluster", "left").withColumn("salt", F.pmod(F.xxhash64("bundle"), F.coalesce("salts", F.lit(1)))).drop("salts")
    return dealt.groupBy("cluster", "salt").applyInArrow(collapsed, BLOCK)


def sampled(one: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a block, and where each one's stretch begins and ends."""
    length = np.asarray(one["length"], dtype=np.int64)
    begin = np.cumsum(length + 1) - length - 1
    at, _ = anchors(np.frombuffer(one["body"], dtype=np.uint8))
    of = np.searchsorted(begin, at, side="right") - 1
    inside = at + GRAM <= (begin + length)[of]  # no gram holds an END
    return at[inside], begin[of[inside]], (begin + length)[of[inside]]


def suffixes(one: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's distinct sampled suffixes with what stands before them, and for each anchor the number of its own.

    Columns: the SPAN bytes from the anchor on and the LEFT before it, nearest first, as numbers in the order of the
    bytes, END beyond the stretch; and the least doc_id.
    """
    at, begin, end = sampled(one)
    data = np.concatenate([np.full(LEFT, END, np.uint8), np.frombuffer(one["body"], dtype=np.uint8), np.full(SPAN, END, np.uint8)])
    length = np.asarray(one["length"], dtype=np.int64)
    least = np.asarray(one["least"], dtype=np.int64)[np.asarray(one["owner"], dtype=np.int64)]
    least = least[np.searchsorted(np.cumsum(length + 1), at, side="right")]
    found, numbers, total = [], [], 0
    for low in range(0, len(at), CHUNK):
        mine = slice(low, low + CHUNK)
        offset = np.arange(-LEFT, SPAN)
        inside = (offset >= (begin[mine] - at[mine])[:, None]) & (offset < (end[mine] - at[mine])[:, None])
        rows = np.where(inside, sliding_window_view(data, LEFT + SPAN)[at[mine]], np.uint8(END))
        right, left = rows[:, LEFT:], rows[:, LEFT - 1 :: -1]
        words = [np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in (right[:, :48], left[:, :16])]
        rest = np.ascontiguousarray(np.concatenate([right[:, 48:], left[:, 16:]], axis=1)).view(">u4").astype(np.uint32)
        columns = [*words[0].T, *words[1].T, rest[:, 0], least[mine]]
        first, number = distinct(columns)
        found.append([c[first] for c in columns])
        numbers.append(total + number)
        total += len(first)
    if not found:
        return [np.empty(0, dtype=k) for k in KINDS], np.empty(0, dtype=np.int64)
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    first, number = distinct(columns)
    return [c[first] for c in columns], number[np.concatenate(numbers)]


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of each, and for every row the number of its own. A clash of hashes only tells some rows twice."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(FACTOR)
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed)
    ranked = mixed[order]
    new = np.ones(len(order), dtype=bool)
    alike = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    one, other = order[alike], order[alike - 1]
    new[alike] = np.any([c[one] != c[other] for c in columns], axis=0)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def grams_of(columns: list[np.ndarray]) -> np.ndarray:
    """The first GRAM bytes of sampled suffixes."""
    return np.stack(columns[: GRAM // 8], axis=1).astype(">u8").view(f"S{GRAM}").ravel()


def unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    width, columns, sizes = sum(np.dtype(k).itemsize for k in KINDS), [[] for _ in KINDS], []
    for data in table.column("data"):
        buffer, at = data.as_buffer(), 0
        n = len(buffer) // width
        sizes.append(n)
        for column, kind in zip(columns, KINDS, strict=True):
            column.append(np.frombuffer(buffer, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in columns], sizes


def beginnings(words: list[np.ndarray], sizes: list[int], order: np.ndarray) -> list[np.ndarray]:
    """For each number of bytes, from none, which rows in this order begin a new string of so many."""
    out = [np.arange(len(order)) == 0]
    for word, size in zip(words, sizes, strict=True):
        ranked, before = word[order], out[-1][1:]
        differ = ranked[1:] ^ ranked[:-1]
        out += [np.append(True, before | (differ >> differ.dtype.type(8 * (size - k)) > 0)) for k in range(1, size + 1)]
    return out


def repeated(columns: list[np.ndarray]) -> np.ndarray:
    """For each sampled suffix, as bits, how far before it strings of SPAN bytes start that a lesser document has too.

    A string that starts d bytes before an anchor is its d bytes before and SPAN - d bytes from it on. In the suffixes'
    order those of equal SPAN - d bytes are neighbours, in the order of what stands before them those of equal d bytes.
    """
    right, left, rest, least = columns[:6], columns[6:8], columns[8], columns[9]
    right, left = [*right, rest >> np.uint32(16)], [*left, rest & np.uint32(0xFFFF)]
    out = np.zeros(len(least), dtype=np.uint32)
    order = np.lexsort(right[::-1])
    new = beginnings(right, [*[8] * 6, 2], order)
    starts = np.flatnonzero(new[GRAM])
    several = (np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(least[order], starts))[np.cumsum(new[GRAM]) - 1]
    mine = order[several]
    if not len(mine):
        return out
    by_left = np.lexsort([c[mine] for c in left[::-1]])
    new_left = beginnings([c[mine] for c in left], [8, 8, 2], by_left)
    least, run = least[mine], np.empty(len(mine), dtype=np.uint64)
    for d in range(WINDOW):
        run[by_left] = np.cumsum(new_left[d])
        both = run << np.uint64(32) | np.cumsum(new[SPAN - d])[several].astype(np.uint64)
        alike = np.argsort(both)
        first = np.append(True, both[alike][1:] != both[alike][:-1])
        lesser = np.minimum.reduceat(least[alike], np.flatnonzero(first))[np.cumsum(first) - 1]
        out[mine[alike[least[alike] > lesser]]] |= np.uint32(1 << d)
    return out


def answered(table: pa.Table) -> pa.Table:
    columns, sizes = unpacked(table)
    pieces = [bits.tobytes() for bits in np.split(repeated(columns), np.cumsum(sizes)[:-1])]
    return pa.table([table.column("part"), table.column("block"), pa.array(pieces, pa.binary())], schema=TOLD)


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """A block's answers, at most one of each part for each of its suffixes, beside it."""
    return rows.join(answers.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers")), "block", "left")


def all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out


def each(make: Callable[[dict], list[dict]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(make(batch.slice(row, 1).to_pylist()[0]), schema)

    return run


def borders_of(blocks: DataFrame, parts: int) -> np.ndarray:
    """Grams that part the suffixes evenly, from a bounded sample; where they lie changes no result."""
    every = max(1, blocks.count() // SAMPLE_BLOCKS)

    def take(one: dict) -> list[dict]:
        at, _, _ = sampled(one)
        at = at[:: max(1, len(at) // SAMPLE)]
        return [{"grams": sliding_window_view(np.frombuffer(one["body"], dtype=np.uint8), GRAM)[at].tobytes()}]

    sample = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("length", "body").mapInArrow(each(take, pa.schema([("grams", pa.binary())])), "grams binary").collect()
    found = np.sort(np.frombuffer(b"".join(r["grams"] for r in sample), dtype=f"S{GRAM}"))
    return found[np.linspace(0, len(found), parts + 1).astype(int)[1:-1]] if len(found) else found


def repeats(blocks: DataFrame, parts: int, rounds: int, folder: str) -> DataFrame:
    """(digest, runs): maximal runs (from, to) of bytes to remove from the text, 64-bit numbers."""
    borders = blocks.sparkSession.sparkContext.broadcast(borders_of(blocks, parts))  # parts * GRAM bytes at most

    def dealt(one: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """A block's suffixes by part, their parts, and for each anchor the place of its own. All of a gram go to one part."""
        columns, number = suffixes(one)
        part = np.searchsorted(borders.value, grams_of(columns), side="right")
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return [c[order] for c in columns], part[order], place[number]

    def tell(turn: int) -> Callable:
        def of(one: dict) -> list[dict]:
            columns, part, _ = dealt(one)
            return [{"part": p, "block": one["block"], "data": b"".join(c[a:b].tobytes() for c in columns)} for p, a, b in slices(part) if p % rounds == turn]

        return each(of, TOLD)

    told = blocks.select("block", "least", "owner", "length", "body")
    answers = all_of([settle(told.mapInArrow(tell(turn), ANSWER).groupBy("part").applyInArrow(answered, ANSWER), folder, f"answers{turn}") for turn in range(rounds)])

    def runs_of(one: dict) -> list[dict]:
        at, begin, end = sampled(one)
        _, part, place = dealt(one)
        answers = {a["part"]: a["data"] for a in one["answers"] or []}
        bits = np.concatenate([np.empty(0, dtype=np.uint32), *[np.frombuffer(answers[p], dtype=np.uint32) for p, _, _ in slices(part)]])[place]
        hit = np.zeros(len(one["body"]), dtype=bool)
        for d in range(WINDOW):
            start = at - d
            hit[start[(bits >> np.uint32(d) & np.uint32(1) > 0) & (start >= begin) & (start + SPAN <= end)]] = True
        hits = np.flatnonzero(hit)
        length = np.asarray(one["length"], dtype=np.int64)
        first = np.cumsum(length + 1) - length - 1
        stretch = np.searchsorted(first, hits, side="right") - 1
        shift = np.asarray(one["start"], dtype=np.int64)[stretch] - first[stretch]
        owner = np.asarray(one["owner"], dtype=np.int64)[stretch]
        out = []
        for text in np.unique(owner).tolist():
            lows = (hits + shift)[owner == text]
            apart = np.flatnonzero(lows[1:] > lows[:-1] + SPAN)
            runs = np.stack([lows[np.append(0, apart + 1)], lows[np.append(apart, len(lows) - 1)] + SPAN], axis=1)
            out.append({"digest": one["digest"][text], "runs": runs.astype(np.int64).tobytes()})
        return out

    return settle(with_answers(blocks, answers).mapInArrow(each(runs_of, pa.schema([("digest", pa.binary()), ("runs", pa.binary())])), "digest binary, runs binary"), folder, "runs")


def united(found: list[bytes]) -> list[list[int]]:
    """Maximal runs of the runs that several blocks have found in a text."""
    out = []
    for low, high in sorted(np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2).tolist()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return out


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for one in batch.slice(at, 256).to_pylist():
                data = (one["text"] or "").encode()
                runs = [(0, len(data))] if one["copy"] else united(one["runs"] or [])
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append({"doc_id": one["doc_id"], "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.RecordBatch.from_pylist(rows, schema)


def without_repeats(docs: DataFrame, suffixes: int = SUFFIXES, round_parts: int = ROUND_PARTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs (doc_id, text).

    Every byte goes that is covered by a string of SPAN bytes which also starts in a row of a smaller
    doc_id, judged on the input; matches don't cross texts. kept holds the remaining bytes, which need
    not be whole characters. A null text is empty; texts of less than SPAN bytes stay as they are. Null
    ids count as larger than all others. Rows that share a doc_id take nothing from each other, be they
    equal or not. An empty table gives an empty result; other columns aren't read, however named. Of
    what is written on the way only the runs and a row for each text stay, for the result to read.
    suffixes: those that one part sorts, about; round_parts: parts of a round, at least.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(LAST)))
    long = F.octet_length("text") >= SPAN
    texts = docs.filter(long).groupBy("digest").agg(F.min("place").alias("least"), F.first("text").alias("text"))
    bundles = settle(texts.mapInArrow(bundled, "block long, digest array<binary>, least array<long>, ends array<long>, body binary"), folder, "bundles")
    size = bundles.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = ceil(size * 2 / (WINDOW + 1) / ANCHORS) or 1
    shared = settle(bundles.select("block", "ends", "body").mapInArrow(tell_anchors(parts), ANSWER).groupBy("part").applyInArrow(shared_anchors, ANSWER), folder, "shared")
    cut = settle(with_answers(bundles, shared).mapInArrow(stretches(parts, ceil(size / BUNDLE) or 1), CUT), folder, "cut")
    facts = shared_dir(spark)
    least = settle(bundles.select(F.explode(F.arrays_zip("digest", "least")).alias("x")).select("x.digest", F.col("x.least").alias("place")), facts, "least")
    for name in ("bundles", "shared"):
        drop_folder(spark, f"{folder}/{name}")
    blocks = settle(blocks_of(cut), folder, "blocks")
    drop_folder(spark, f"{folder}/cut")
    marks = settle(blocks.select(F.explode(F.arrays_zip("digest", "marks")).alias("x")).select("x.digest", F.col("x.marks").alias("runs")).filter(F.octet_length("runs") > 0), facts, "marks")
    blocks = blocks.drop("marks")
    total = blocks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    sorted_ = total * 2 / (WINDOW + 1)
    sorts = ceil(sorted_ / suffixes) or 1
    shuffled = sorted_ * sum(np.dtype(k).itemsize for k in KINDS)
    runs = repeats(blocks, sorts, max(1, min(ceil(shuffled / (size or 1)), sorts // round_parts)), folder)
    # a long text that isn't found under its own id stands, as a whole, under a smaller one
    found = runs.unionByName(marks).groupBy("digest").agg(F.collect_list("runs").alias("runs"))
    known = settle(least.join(found, "digest", "left").withColumn("known", F.lit(True)), facts, "known")
    for name in ("least", "marks"):
        drop_folder(spark, f"{facts}/{name}")
    drop_folder(spark, folder)
    rows = docs.join(known, ["digest", "place"], "left").select("doc_id", "text", "runs", (F.col("known").isNull() & F.coalesce(long, F.lit(False))).alias("copy"))
    return rows.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op11_suffix_array_dedup(spark, sf_dir):
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
