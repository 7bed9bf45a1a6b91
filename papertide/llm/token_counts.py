"""Token counts with the whole-token shortcut.

Offline, the vocabulary itself proves which strings encode alone as one token. A text then splits
where no merge can cross, its pre-tokens that are whole tokens count 1 each by a lookup, and only
the rest is merged by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, tokenizer_path

#: Pre-tokens: spaces and the word behind them, loose spaces, line feeds.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Word counts that a Python worker keeps, and the longest word kept.
KEEP, KEEP_CHARS = 400_000, 64


class WordCounts(dict):
    """Tokens of each pre-token: proven whole tokens are laid in, others merged when first met."""

    def __init__(self, model, whole: dict[str, int]):
        super().__init__(whole)
        self.model, self.whole = model, whole

    def __missing__(self, word: str) -> int:
        n = merged_count(self.model, word)
        if len(word) <= KEEP_CHARS:
            if len(self) > len(self.whole) + KEEP:
                self.clear()
                self.update(self.whole)
            self[word] = n
        return n


def merged_count(model, word: str) -> int:
    """Tokens of one pre-token; the library itself puts one space before what it encodes."""
    if word[0] == " ":
        return len(model.encode(word[1:])) if len(word) > 1 else 1
    return len(model.encode("\n" + word)) - 2  # without the space and the line feed before it


def splits_safely(model) -> bool:
    """Whether merges can't cross pre-tokens: no piece has a space behind another character or a line
    feed, a line feed is one byte token, and the library changes no text but for its leading space."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
    probe = "a\n ﬁ① \t  　é x "
    same = model.decode(model.encode(probe)) == probe and [len(model.encode(x)) for x in ("", "\n", "a\nb")] == [0, 2, 3]
    return same and not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)


def whole_tokens(model) -> dict[str, int]:
    """Vocabulary strings that, alone as a pre-token, encode as exactly one token."""
    words = {model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if model.is_control(i) is False and not model.is_byte(i) and not model.is_unknown(i)}
    return {w: 1 for w in words if w and PRE_TOKEN.fullmatch(w) and merged_count(model, w) == 1} | {"\n": 1, " ": 1}


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a text to its tokens, by the library that the file is for; kept by each Python worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if not splits_safely(model):
        return lambda text: len(model.encode(text))
    counts = WordCounts(model, whole_tokens(model))
    of = counts.__getitem__
    return lambda text: sum(map(of, PRE_TOKEN.findall(" " + text.replace("▁", " ")))) if text else 0


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to docs; columns of these names are replaced.

    A null text counts as empty: no bytes, no tokens. Texts are read whole, whatever their length;
    repeated rows stay repeated. Nothing is shuffled. Vocabulary files: .model (sentencepiece, with
    the shortcut where the vocabulary proves it) and .json (tokenizers).
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "n_tokens": tokens(F.col(text)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
