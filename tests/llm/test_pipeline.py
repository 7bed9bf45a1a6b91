"""The pipeline's stages, each on what the one before kept, against brute force."""

import collections
import os



import pytest

import corpus_pipeline
from papertide.llm import common, quality, secrets_index

from .test_llm import base_rules, components, spans_in

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], DATA)
        out.write.parquet(f"file://{tmp_path}/{n}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{n}"))
    assert all(k.columns == columns for k in kept[:-1])
    text = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:-1]]

    judged = {r["doc_id"]: r["kept"] for r in quality.with_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert set(text[1]) == {d for d, k in judged.items() if k} and not any(base_rules(text[0][d])[-1] for d in text[1])
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    assert all(judged[d] for d in good if not base_rules(text[0][d])[-1])  # clean documents stay

    assert set(text[2]) == {c for _, _, c in components(sorted(text[1].items()))}
    assert all(text[2][d] == text[1][d] for d in text[2])

    assert set(text[3]) == set(text[2])
    for d, t in text[3].items():
        assert not [s for s in spans_in(t, secrets_index.RULES) if s[1] < 3]
        assert (t == text[2][d]) == (not spans_in(text[2][d], secrets_index.RULES))
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect() if r["text"] != text[2][r["doc_id"]])

    tokenizer = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    lengths, sequences = collections.Counter(), collections.Counter()
    for r in kept[4].collect():
        lengths[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert lengths == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in text[3].items()}
    assert max(sequences.values()) <= 2048


def test_run_is_the_stages(spark):
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.run(spark, DATA).count() > 0


def test_only_what_the_result_reads_stays(spark):
    common.release(spark)
    out = corpus_pipeline.run(spark, DATA)
    read = out.inputFiles()
    assert common.made() and all(any(os.path.basename(folder) in file for file in read) for folder in common.made())
    assert out.count() > 0
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert len(os.listdir(f"{base}/papertide")) == len(common.made())
    common.release(spark)
    assert not os.listdir(f"{base}/papertide")


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, member_of int, ids string, sequence_id string"


def odd_rows():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    fresh = [" ".join(word() for _ in range(80)) for _ in range(20)]
    texts = [(None, t) for t in fresh[:12]] + [(None, fresh[0]), (1, fresh[13]), (1, fresh[13]), (2, fresh[13] + " tail"), (3, fresh[14] + " password=abcdef99"), (None, None), (4, ""), (5, " \n"), (6, "few words"), (7, " ".join(word() for _ in range(60_000)))]
    return [(d, t, "en", "s", None if t is None else len(t), "k", 1, 2, "i", "q") for d, t in texts], fresh


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, blank and long texts and clashing names; and no rows at all."""
    rows, fresh = odd_rows()
    base = f"file://{tmp_path}/in"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    for name, some in (("all", rows), ("none", [])):
        docs = spark.createDataFrame(some, ODD)
        out = []
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, base).write.parquet(f"{base}/{name}{n}")
            docs = spark.read.parquet(f"{base}/{name}{n}")
            out.append(docs.collect())
        if not some:
            assert out == [[], [], [], []]
            continue
        assert collections.Counter((r["doc_id"], r["text"]) for r in out[0]) == collections.Counter((d, t) for d, t, *_ in rows if not base_rules(t)[-1])
        assert sorted(r["text"] for r in out[1]) == sorted([*fresh[:12], fresh[13], fresh[14] + " password=abcdef99", rows[-1][1]])
        assert [r["doc_id"] for r in out[1] if r["text"] == fresh[13]] == [1]
        assert {r["text"] for r in out[1]} - {r["text"] for r in out[2]} == {fresh[14] + " password=abcdef99"} and len(out[2]) == len(out[1])
        assert {(r["doc_id"], r["doc_tokens"]) for r in out[3] if r["doc_id"]} and len({r["sequence_id"] for r in out[3]}) > 1
