"""Operator 5: token counts.

A text's token count is the sum, over its distinct pre-tokens, of their frequency times their number of
pieces. The pieces of a pre-token are counted once: each slice of documents is reduced to its distinct
pre-tokens, these are joined to the counts already known to the worker (a bounded table of two generations, of which the
older is dropped when the younger is full, so that what is in use stays), only new ones are run through the BPE model, and the counts are joined back to the per-document frequencies and summed. No id
sequence of a document is ever built, and no row is shuffled, so a pre-token that is in every document
(' the') costs no more than any other.

Defined cases: null or empty text has 0 bytes and 0 tokens; strings of the vocabulary's added tokens inside a
text count as one token, as the library does by default; U+0000 is a character like others; a text of exactly the limit isn't over it; repeated rows are counted each;
other columns, whatever their names, are ignored; texts may be of any length that a row can have, one of them is held by a worker at
a time with its pre-tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrazone.llm.common import map_texts

# Fixed value: the pre-token pattern of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens of a generation whose counts a worker keeps, and the length over which none is kept.
KEPT, KEPT_CHARS = 400_000, 48


class PieceCounts:
    """Counts of pieces by pre-token, for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: a byte-level BPE vocabulary without normalizer is needed")
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path}: added tokens that strip or match whole words aren't supported")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = regex.compile(BYTE_LEVEL).findall
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand between them."""
        if self.added is None or not self.added.search(text):
            return self.split(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def pieces(self, distinct: list[str]) -> np.ndarray:
        known, older = self.known, self.older
        counts = np.fromiter((known.get(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(counts < 0)
        if not len(new):
            return counts
        counts[new] = [older.get(distinct[i], -1) for i in new]
        unmet = np.flatnonzero(counts < 0)
        if len(unmet):
            counts[unmet] = [len(e.ids) for e in self.model.encode_batch([distinct[i] for i in unmet], add_special_tokens=False)]
        for i in new:
            if len(distinct[i]) <= KEPT_CHARS:
                if len(self.known) >= KEPT:
                    self.older, self.known = self.known, {}
                self.known[distinct[i]] = int(counts[i])
        return counts

    def totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        flat: list[str] = []
        sizes, totals = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found, totals[i] = self.pretokens(text)
            flat += found
            sizes[i] = len(found)
        if not flat:
            return totals
        # numbered by a dict: pandas' own numbering of strings ends each at its first U+0000
        number: dict[str, int] = {}
        codes = np.fromiter((number.setdefault(p, len(number)) for p in flat), np.int64, len(flat))
        distinct = list(number)
        pieces = self.pieces(distinct)
        # frequencies of (document, pre-token), joined to the pieces of the pre-token
        pairs, often = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(distinct) + codes, return_counts=True)
        return totals + np.bincount(pairs // len(distinct), often * pieces[pairs % len(distinct)], len(texts)).astype(np.int64)


@lru_cache(2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    kind = dict(df.dtypes)[id_col]

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = piece_counts(vocabulary)

        def step(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = counts.totals(texts)
            return {id_col: part.column("id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": tokens > limit}

        return step

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_texts(picked, make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
