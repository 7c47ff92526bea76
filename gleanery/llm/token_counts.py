"""Token counts by rank-synchronous merging.

A batch of pre-tokens is one flat array of symbols with the sequence each belongs to. In each round every sequence applies
its pair of lowest rank, wherever it stands, all sequences at once; symbols left when no pair has a rank are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .pieces import PieceEncoder

_NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class PairTable:
    """(left id, right id) -> rank and merged id, by open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right
        bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        self.probes = 1
        waiting, at, step = np.arange(len(keys)), self._home(keys), 0
        while len(waiting):
            free = self.keys[at] == -1
            order = waiting[free][::-1]
            self.keys[at[free][::-1]] = keys[order]  # of several keys for a slot the first stays
            placed = self.keys[at] == keys[waiting]
            self.rank[at[placed]], self.merged[at[placed]] = waiting[placed], merged[waiting[placed]]
            waiting, at = waiting[~placed], (at[~placed] + 1) & self.mask
            step += 1
        self.probes = max(1, step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; its rank there is the largest number if it has none."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys[open_]
            found[open_[hit]] = at[hit]
            go = ~hit & (held != -1)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & self.mask
        return found

    def ranks(self, slots: np.ndarray) -> np.ndarray:
        return np.where(slots >= 0, self.rank[slots], _NONE)


class RankCounter:
    """Counts of tokens of pre-tokens, for the vocabulary of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocab = said["model"]["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in said["model"]["merges"]]
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.of_byte = np.array([vocab[letter] for _, letter in sorted(byte_letters().items())], np.int32)
        left, right, merged = (np.array(x, np.int32) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        self.pairs = PairTable(left, right, merged)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = np.zeros(len(tokens), np.int64)
        while len(symbols):
            joined = owner[1:] == owner[:-1]
            slots = np.full(len(symbols), -1, np.int64)
            slots[:-1][joined] = self.pairs.find(symbols[:-1][joined], symbols[1:][joined])
            ranks = self.pairs.ranks(slots)
            starts = np.flatnonzero(np.r_[True, ~joined])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            counts[owner[starts]] = sizes
            alive = lowest < _NONE
            if not alive.any():
                break
            merge = (ranks == np.repeat(lowest, sizes)) & np.repeat(alive, sizes)
            # in a run such as a-a-a every second pair merges, from the left
            at = np.arange(len(symbols))
            run_start = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], at, 0))
            merge &= (at - run_start) % 2 == 0
            symbols = np.where(merge, self.pairs.merged[slots], symbols)
            keep = ~np.r_[False, merge[:-1]] & np.repeat(alive, sizes)  # sequences that are done leave the arrays
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def encode_many(self, tokens: list[str]) -> Iterator[int]:
        special = set(self.special)
        counts = self.count([token.encode() for token in tokens]).tolist()
        return (1 if token in special else count for token, count in zip(tokens, counts))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    The special string of the vocabulary counts as one token wherever it stands, as the library has it by default.
    A null or empty text has 0 bytes and 0 tokens. Null ids and repeated rows are carried along row by row; other columns of
    docs, whatever their names, are ignored. No shuffle; whole texts, in slices of bounded size.
    """
    counter = docs.sparkSession.sparkContext.broadcast(RankCounter(path))  # bounded: the vocabulary

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = PieceEncoder(pattern, counter.value.encode_many, sum, counter.value.special)
        for texts in parts:
            yield pd.Series([n for part in slices(texts) for n in encoder.encode(part)], dtype="int64")

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    counted = docs.select(F.col(id_col).alias("doc_id"), n_bytes.alias("n_bytes"), count(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
