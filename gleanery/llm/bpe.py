"""Byte-level BPE encoding and decoding by two tiers.

A minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry as it stands; the others are
merged on a doubly linked list of bytes, with a heap that yields the pair of lowest rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .pieces import PieceEncoder

_MASK = (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct byte strings, one each, by hash and displace.

    Keys are dealt into n/4 buckets; the fullest choose first the smallest displacement that puts all their keys on free
    slots; buckets of one key name a free slot outright (stored as -slot-1). A look-up is one hash and one table read.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        self.displacement = np.zeros(self.buckets, np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(key) for key in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken = np.zeros(self.n, bool)
        free: list[int] | None = None
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = hashes[order[starts[b] : starts[b + 1]]]
            if sizes[b] == 1:
                free = np.flatnonzero(~taken).tolist() if free is None else free
                self.displacement[b] = -free.pop() - 1
                continue
            first = 0
            while True:
                tried = self._slots(own[None, :], np.arange(first, first + 64, dtype=np.uint64)[:, None])
                fits = ~taken[tried].any(axis=1)
                ordered = np.sort(tried, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.flatnonzero(fits)[0])
                    self.displacement[b] = first + k
                    taken[tried[k]] = True
                    break
                first += 64
        self._lookup = self.displacement.tolist()

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for what is no key."""
        hashed = xxhash.xxh64_intdigest(key)
        shift = self._lookup[hashed % self.buckets]
        if shift < 0:
            return -shift - 1
        return ((((hashed ^ (shift * 0x9E3779B97F4A7C15 & _MASK)) * 0xD6E8FEB86659FD93) & _MASK) >> 32) % self.n


class BytePairCoder:
    """Ids of pre-tokens and bytes of ids, for a vocabulary of merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.id_at = [0] * len(keys)
        for key in keys:
            slot = self.hash.slot(key)
            self.key_at[slot], self.id_at[slot] = key, ranks[key]
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode_pretoken(self, token: bytes) -> list[int]:
        slot = self.hash.slot(token)
        if self.key_at[slot] == token:
            return [self.id_at[slot]]
        return self._merge(token)

    def _merge(self, token: bytes) -> list[int]:
        rank_of, n = self.ranks.get, len(token)
        end = list(range(1, n + 1))  # of the symbol that starts here
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, left, stop = heapq.heappop(heap)
            middle = end[left]
            if gone[left] or middle >= n or end[middle] != stop or middle == stop:
                continue  # one of its halves has been merged meanwhile
            gone[middle] = True
            end[left] = stop
            if stop < n:
                before[stop] = left
                if (rank := rank_of(token[left : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, left, end[stop]))
            if (prior := before[left]) >= 0 and (rank := rank_of(token[prior:stop])) is not None:
                heapq.heappush(heap, (rank, prior, stop))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[token[at : end[at]]])
            at = end[at]
        return ids

    def encode_many(self, tokens: list[str]) -> Iterator[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        for token in tokens:
            yield array("I", self.encode_pretoken(token.encode())).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def token_ids(spark: SparkSession, text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """binary: the ids of a text (null: none) as little-endian unsigned 32-bit integers, without special tokens."""
    coder = spark.sparkContext.broadcast(BytePairCoder(load_ranks(path)))  # bounded: the vocabulary

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = PieceEncoder(pattern, coder.value.encode_many, b"".join)
        for texts in parts:
            yield pd.Series([ids for part in slices(texts) for ids in encoder.encode(part)], dtype=object)

    return encode(text)


def token_text(spark: SparkSession, ids: Column, path: str) -> Column:
    """binary: the bytes that ids stand for (null: none)."""
    coder = spark.sparkContext.broadcast(BytePairCoder(load_ranks(path)))

    @F.pandas_udf("binary")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            yield pd.Series([coder.value.decode(np.frombuffer(x or b"", "<u4")) for x in column], dtype=object)

    return decode(ids)


def encode_decode_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_tokens, SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded bytes.

    A null or empty text has no ids: 0 tokens and the digest of nothing, twice. Null ids and repeated rows are carried along
    row by row. Other columns of docs, whatever their names, are ignored. Texts are encoded whole, whatever their length.
    No shuffle: each task reads its rows and keeps only the current batch of ids.
    """
    coder = docs.sparkSession.sparkContext.broadcast(BytePairCoder(load_ranks(path)))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(pattern, coder.value.encode_many, b"".join)
        for texts in parts:
            rows = []
            for part in slices(texts):
                for packed in encoder.encode(part):
                    decoded = coder.value.decode(np.frombuffer(packed, "<u4"))
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
