"""The suffix sort against brute force: bytes covered by fifty that start in an earlier document."""

import hashlib
import random
import re

import pytest

from papertide.llm import suffix_dedup

LAST = 2**63 - 1


def brute(rows):
    place = lambda i: LAST if i is None else i
    first, out = {}, []
    for i, text in rows:
        data = (text or "").encode()
        for j in range(len(data) - 49):
            first[data[j : j + 50]] = min(place(i), first.get(data[j : j + 50], LAST))
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - 49):
            if first[data[j : j + 50]] < place(i):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", b"d", 1) for i, t in rows], "doc_id long, text string, block string, digest binary, place int").repartition(3)
    found = suffix_dedup.without_repeats(docs, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    return sorted(((*r[:5], bytes(r[5])) for r in found), key=repr)


def mixed(seed, n):
    """Texts of shared passages and own letters, with copies, repeats within a text and shared edges of 48 to 52 bytes."""
    rng = random.Random(seed)
    letters = lambda k, some="abc é": "".join(rng.choice(some) for _ in range(k))
    passages = [letters(rng.randint(40, 160)) for _ in range(6)] + ["ab" * 60, " " * 130, letters(49, "xy"), letters(50, "xy"), letters(51, "xy")]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(passages), letters(rng.randint(0, 30))]) for _ in range(rng.randint(0, 7)))
        rows.append((rng.choice([i, i, i, max(0, i - 1), None]), text if rng.random() > 0.05 else None))
        if rng.random() < 0.2:
            rows.append((i + 1000 if rng.random() < 0.5 else i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mixtures(spark, seed):
    rows = mixed(seed, 60)
    assert run(spark, rows, suffixes=700, round_parts=2) == brute(rows)


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400_000))
    rows = [(5, None), (5, ""), (6, "x" * 49), (7, "x" * 49), (8, "x" * 50), (9, "x" * 50), (9, "x" * 50), (None, "x" * 51), (None, "y" * 60), (None, "y" * 60), (3, "é" * 26), (4, "aé" + "é" * 25), (10, "a\0b" * 40), (2, "\0b" * 30), (1, "short")]
    assert run(spark, rows) == brute(rows)
    got = {r[0]: r for r in run(spark, [(1, "p" + long), (2, long + "q"), (3, long[1000:2000])])}
    assert (got[1][2], got[2][2], got[3][2]) == (0, 400_000, 1000) and got[2][5] == b"q"


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == brute([(1, None)])


def test_a_block_holds_a_passage_of_many_documents_once(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 25) for i in range(3000))
    rows = [(f"{i:b}".encode() + passage.encode(), i) for i in (3, 1, 2)]
    cut = [
        {"cluster": 5, "bundle": n, "digest": [b"%d" % i], "least": [i], "owner": [0], "start": [10], "length": [len(text)], "body": text + b"\xff"} for n, (text, i) in enumerate(rows)
    ]
    (block,) = suffix_dedup.blocks_of(spark.createDataFrame(cut, suffix_dedup.CUT)).collect()
    assert bytes(block.body).count(passage[100:2900].encode()) == 1
    assert len(block.body) < len(passage) + 400
    assert {bytes(d): bool(m) for d, m in zip(block.digest, block.marks, strict=True)} == {b"1": False, b"2": True, b"3": True}


def test_large_clusters_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CLUSTER", 300)
    monkeypatch.setattr(suffix_dedup, "BUNDLE", 500)
    rows = mixed(3, 40)
    assert run(spark, rows, suffixes=700, round_parts=2) == brute(rows)


def test_the_sort_shuffles_its_suffixes_once(spark, monkeypatch):
    written, settle = [], suffix_dedup.settle
    monkeypatch.setattr(suffix_dedup, "settle", lambda df, folder, name: written.append(name) or settle(df, folder, name))
    rows = mixed(4, 40)
    assert run(spark, rows) == brute(rows)
    assert len(written) <= 9  # bundles, shared, cut, least, blocks, marks, answers, runs, known


def test_every_string_has_a_sampled_suffix_near(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000)).encode() + b"z" * 5000
    one = {"least": [1], "owner": [0], "start": [0], "length": [len(text)], "body": text + b"\xff"}
    at, _, _ = suffix_dedup.sampled(one)
    assert set(range(len(text) - 49)) <= {a - d for a in at.tolist() for d in range(suffix_dedup.WINDOW)}
    columns, number = suffix_dedup.suffixes(one)
    assert len(number) == len(at) and len(columns[0]) < 20_000 / 5
