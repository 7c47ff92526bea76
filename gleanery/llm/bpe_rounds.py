"""BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. Each round finds every word's pair of lowest rank and merges it wherever it
stands, all words at once; ranks of pairs come from a binary search over the sorted keys of all pairs, asked only where a merge
has made a new pair. Words that have no ranked pair left leave the array.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .pieces import PieceEncoder
from .token_counts import byte_letters

_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Pairs of symbols by binary search: rank (place in the file's list of merges) and the symbol that a pair becomes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0] if len(keys) else np.zeros(0, bool)  # of a repeated pair the lowest rank
        order = order[first]
        self.keys, self.rank_at = keys[order], order.astype(np.int32)
        self.merged = merged.astype(np.int32)  # by rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the largest number where it has none."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_at[at], _NONE)


def every_second(hit: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """hit without those that overlap the one before: in a run such as a-a-a every second pair merges, from the left.

    `follows` says of each place whether it is a pair's second symbol for the place before it in the arrays.
    """
    at = np.arange(len(hit))
    begins = hit & ~(follows & np.r_[False, hit[:-1]])
    start = np.maximum.accumulate(np.where(begins, at, 0))
    return hit & ((at - start) % 2 == 0)


class RoundsCoder:
    """Ids of words and bytes of ids, as the tokenizers library has them for a byte-level BPE file.

    Files with other parts than a plain byte-level BPE (a normalizer, dropout, pieces within words, added strings that take up
    white space) are refused: their ids would differ.
    """

    def __init__(self, path: str, longest: int = 256):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, before = said["model"], said.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [x["content"] for x in said.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]
        if odd or said.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {odd or path}")
        letters = byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        self.special, self.longest = list(added), longest
        self.special_ids = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.table = MergeTable(*(np.array(x, np.int32) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs])))
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def _rounds(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of (the word's number, its symbols), each word whole in one part."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        joined = owner[1:] == owner[:-1]
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1][joined] = self.table.ranks(symbols[:-1][joined], symbols[1:][joined])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            done = lowest == _NONE
            if done.any():
                yield owner[done], symbols[done]
                symbols, owner, ranks, lowest = symbols[~done], owner[~done], ranks[~done], lowest[~done]
                if not len(symbols):
                    return
            merge = every_second(ranks == lowest, np.ones(len(ranks), bool))
            symbols[merge] = self.table.merged[ranks[merge]]
            stay = ~np.r_[False, merge[:-1]]
            gone_next = np.r_[merge[1:], False]  # the pair of the place before a merge is new as well
            fresh = (merge | gone_next)[stay]
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            ranks[-1] = _NONE
            at = np.flatnonzero(fresh[:-1])
            inside = owner[at] == owner[at + 1]
            ranks[at[~inside]] = _NONE
            at = at[inside]
            ranks[at] = self.table.ranks(symbols[at], symbols[at + 1])

    def _ranked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Like _rounds, for long words: a round merges the lowest rank of all words and asks only for the pairs about it.

        Time follows the length, not its product with the number of different merges.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner, n = np.repeat(np.arange(len(words)), sizes), int(sizes.sum())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        after[np.cumsum(sizes) - 1] = n
        before[np.r_[0, np.cumsum(sizes)[:-1]]] = -1
        ranks = np.full(n, _NONE, np.int32)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def ask(at: np.ndarray) -> None:
            last = after[at] == n
            ranks[at[last]] = _NONE
            at = at[~last]
            ranks[at] = found = self.table.ranks(symbols[at], symbols[after[at]])
            at, found = at[found < _NONE], found[found < _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(at) else []
            for rank, places in zip(found[cuts].tolist() if len(at) else [], np.split(at, cuts[1:]) if len(at) else []):
                if rank not in waiting:
                    heapq.heappush(heap, rank)
                waiting[rank].append(places)

        ask(np.arange(n))
        alive = np.ones(n, bool)
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            at = at[every_second(np.ones(len(at), bool), np.r_[False, after[at[:-1]] == at[1:]])]
            if not len(at):
                continue
            second = after[at]
            third = after[second]
            symbols[at], alive[second], after[at] = self.table.merged[rank], False, third
            before[third[third < n]] = at[third < n]
            ask(np.unique(np.r_[at, before[at][before[at] >= 0]]))
        return owner[alive], symbols[alive]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        for numbers, merge in (([k for k, w in enumerate(words) if len(w) <= self.longest], self._rounds), ([k for k, w in enumerate(words) if len(w) > self.longest], lambda w: [self._ranked(w)])):
            for owner, symbols in merge([words[k] for k in numbers]) if numbers else ():
                packed = symbols.astype("<u4").tobytes()
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]).tolist() if len(owner) else []
                for k, start, end in zip(owner[cuts[:-1]].tolist(), cuts, cuts[1:]):
                    out[numbers[k]] = packed[4 * start : 4 * end]
        return out

    def encode_many(self, tokens: list[str]) -> Iterator[bytes]:
        found = self.encode_words([token.encode() for token in tokens])
        return (self.special_ids.get(token, ids) for token, ids in zip(tokens, found))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 come as U+FFFD, as the library has it."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def token_ids(spark: SparkSession, text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """array<int>: the ids of a text (null: none); special strings within it are one id each."""
    coder = spark.sparkContext.broadcast(RoundsCoder(path))  # bounded: the vocabulary

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = PieceEncoder(pattern, coder.value.encode_many, b"".join, coder.value.special)
        for texts in parts:
            yield pd.Series([np.frombuffer(ids, "<i4") for part in slices(texts) for ids in encoder.encode(part)], dtype=object)

    return encode(text)


def token_text(spark: SparkSession, ids: Column, path: str) -> Column:
    """string: what ids (null: none) stand for."""
    coder = spark.sparkContext.broadcast(RoundsCoder(path))

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            yield pd.Series([coder.value.decode(np.asarray([] if x is None else x, np.int64)) for x in column], dtype=object)

    return decode(ids)


def encode_decode_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_tokens, SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded text.

    A special string of the vocabulary within a text is its one id and decodes to itself. A null or empty text has no ids: 0
    tokens and the digest of nothing, twice. Null ids and repeated rows are carried along row by row; other columns of docs,
    whatever their names, are ignored. Texts are encoded whole, whatever their length or the length of their words. No
    shuffle: a task holds a slice of about a million characters (or one longer text), and words it remembers, bounded in bytes.
    """
    coder = docs.sparkSession.sparkContext.broadcast(RoundsCoder(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(pattern, coder.value.encode_many, b"".join, coder.value.special)
        for texts in parts:
            rows = []
            for part in slices(texts):
                for packed in encoder.encode(part):
                    decoded = coder.value.decode(np.frombuffer(packed, "<u4")).encode()
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def op13_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
