"""Token ids on disk: one zstandard frame a document, all with a shared dictionary.

A store is a folder of three tables, written by Spark's own committer, so any file system will do and a lost executor leaves
no half-written file behind:

``dictionary``  one row: SHA-256 of the dictionary, its bytes, and the bytes an id takes in a frame (2 or 4).
``blocks``      consecutive documents: shard, block, dictionary hash, ``first`` (ids of the shard's documents before it), doc_ids,
                counts (ids of each), offsets (where each frame begins, and the end), frames (the frames, end to end).
``shards``      shard, n_docs, n_tokens, first (ids of all shards before it).

Shards, blocks and the documents in them ascend by doc_id. To read one document, take its block's row, cut its frame out by
offsets and decompress that alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read_table, slices
from .pieces import PieceBook, pretokens_of_many, split_many
from .token_counts import byte_letters

_ID = attrgetter("id")
_LEARNT_AT_ONCE = 1 << 14  # pieces
_LETTERS_AT_ONCE = 1 << 22  # of texts that are looked up together: the more, the fewer pieces come in two of them
_BLOCK = "shard int, block int, dictionary_hash string, first long, doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"


class LibraryEncoder:
    """Ids of texts by the tokenizers library, from a tokenizer file's content, as little-endian numbers of `width` bytes.

    Where the file's settings make pieces independent of each other (byte-level pre-tokens, no normalizer, plain special
    strings), the library is asked once for each distinct pre-token that is remembered; else for each text.
    """

    def __init__(self, content: str, capacity: int = 450_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.width = Tokenizer.from_str(content), id_width(content)
        self._kind, self._tokenize = {2: "H", 4: "I"}[self.width], self.tokenizer.model.tokenize
        said = json.loads(content)
        before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(map(str.isspace, x["content"])) for x in added)
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.books: list[PieceBook] = []
        if plain and byte_level and not said.get("normalizer") and not said.get("truncation"):
            self.special = {x["content"]: array(self._kind, [self.tokenizer.token_to_id(x["content"])]).tobytes() for x in added}
            strings = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
            self._special = re.compile(f"({strings})") if strings else None
            self._find = regex.compile(public_tokenizers.PATTERN).findall
            self._letters = np.zeros(256, "<u2")  # the stand-in of each byte, and of the byte that no text holds a space
            for byte, letter in (byte_letters() | {0xFF: " "}).items():
                self._letters[byte] = ord(letter)
            self.books = [PieceBook(capacity), PieceBook(capacity)]  # of pieces as they stand, and of pieces behind a space

    def _pretokens(self, text: str) -> list[str]:
        """Of one text, whatever it holds."""
        if self._special is None or self._special.search(text) is None:
            return self._find(text)
        return [token for k, part in enumerate(self._special.split(text)) for token in ([part] if k % 2 else self._find(part))]

    def _ids(self, tokens: list[str]) -> list[bytes]:
        """Of pre-tokens, by the library's model: no other step of it bears on them."""
        letters = self._letters[np.frombuffer("\udcff".join(tokens).encode("utf-8", "surrogateescape"), np.uint8)].tobytes().decode("utf-16-le").split(" ")
        found = list(map(self._tokenize, letters))
        ids = array(self._kind, map(_ID, chain.from_iterable(found))).tobytes()
        ends = [self.width * n for n in accumulate(map(len, found))]
        return [ids[start:end] for start, end in zip([0, *ends], ends)]

    def _tokens(self, tokens: list[str]) -> dict[str, bytes]:
        """The values of distinct pre-tokens, which are pieces as well and are remembered as such."""
        values = {token: self.special[token] for token in tokens if token in self.special} if self.special else {}
        behind, other = [x for x in tokens if x[0] == " "], [x for x in tokens if x[0] != " " and x not in values]
        for book, names, keys in ((self.books[1], behind, [x[1:] for x in behind]), (self.books[0], other, other)):
            found = book.known(keys)
            new = [k for k, value in enumerate(found) if value is None]
            if new:
                made = self._ids([names[k] for k in new])
                book.keep([keys[k] for k in new], made)
                for k, value in zip(new, made):
                    found[k] = value
            values.update(zip(names, found))
        return values

    def _learn(self, book: PieceBook, lead: str, pieces: list[str]) -> dict[str, bytes]:
        """The values of distinct pieces that the book does not know."""
        if self._special is not None and self._special.search("\0".join(pieces)):
            values, others = {}, pieces
            cut = [self._pretokens(lead + piece) for piece in pieces]
        else:
            letters = list(filter(str.isalpha, pieces))  # as most pieces: one pre-token
            values = dict(zip(letters, self._ids([lead + piece for piece in letters]))) if letters else {}
            book.keep(letters, values.values())
            others = [piece for piece in pieces if piece not in values]
            cut = pretokens_of_many([lead + piece for piece in others], self._find)
        value = self._tokens(list(dict.fromkeys(chain.from_iterable(cut)))).__getitem__
        made = [b"".join(map(value, tokens)) for tokens in cut]
        book.keep(others, made)
        values.update(zip(others, made))
        return values

    def _values(self, book: PieceBook, pieces: list[str]) -> list[bytes]:
        found = book.known(pieces)
        new = [k for k, value in enumerate(found) if value is None]
        for start in range(0, len(new), _LEARNT_AT_ONCE):
            part = new[start : start + _LEARNT_AT_ONCE]
            values = self._learn(book, " " if book is self.books[1] else "", [pieces[k] for k in part])
            for k in part:
                found[k] = values[pieces[k]]
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.books:
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield array(self._kind, found.ids).tobytes()
            return
        plain, spaced = self.books = [book.following() for book in self.books]
        whole, rests = split_many(texts)
        firsts = list(dict.fromkeys(chain.from_iterable(whole)))
        first = dict(zip(firsts, self._values(plain, firsts))).__getitem__
        pieces = rests.flatten().dictionary_encode()  # a piece that comes often in these texts is looked up once
        joined = pa.array(self._values(spaced, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        _, ends, ids = joined.buffers()
        ends = np.frombuffer(ends, np.int64)[rests.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(texts) + 1)
        ids = memoryview(ids or b"")
        for own, start, end in zip(whole, ends, ends[1:]):
            yield b"".join([*map(first, own), ids[start:end]])


@lru_cache(1)
def _encoder(content: str) -> LibraryEncoder:
    """One a Python worker: what it has learnt serves later tasks too."""
    return LibraryEncoder(content)


def id_width(content: str) -> int:
    said = json.loads(content)
    return 2 if max([*said["model"]["vocab"].values(), *(x["id"] for x in said.get("added_tokens", []))]) < 1 << 16 else 4


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; empty if there is too little to train one."""
    try:
        return zstandard.train_dictionary(size, [x for x in samples if len(x) >= 16]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, level: int = 3, dictionary_size: int = 1 << 16, sample_docs: int = 1000, sample_chars: int = 1 << 14, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id and write the store.

    The dictionary is trained on at most `sample_docs` documents, the first by a hash of their id, of longer ones on a stretch of
    `sample_chars` characters at a place by that hash; it bears on size only, and every document is compressed with it. Null ids
    come first; a null text is empty (its one id is end_id); rows of one id lie together, over as many shards as they fill and
    within each the shorter first; an empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as file:
        content = file.read()
    width = id_width(content)
    tokenizer = spark.sparkContext.broadcast(content)  # bounded: the vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    end = end_id.to_bytes(width, "little")

    def serialized(encoder: LibraryEncoder, texts) -> Iterator[bytes]:
        for part in slices(texts, _LETTERS_AT_ONCE):
            for ids in encoder.encode(part):
                yield ids + end

    @F.pandas_udf("binary")
    def sampled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer.value)
        for texts in parts:
            yield pd.Series(list(serialized(encoder, texts)), dtype=object)

    # at most sample_docs ids are broadcast
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - sample_chars + 1, F.lit(1))).cast("int") + 1
    stretches = rows.where("text is not null").select("doc_id", F.substring("text", place, sample_chars).alias("text"))
    chosen = rows.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    samples = stretches.join(F.broadcast(chosen), "doc_id", "left_semi").select(sampled("text").alias("ids")).limit(sample_docs).collect()
    data = train_dictionary(sorted(bytes(x.ids) for x in samples), dictionary_size)
    name = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(name, data, width)], "hash string, data binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)  # where null ids stand
    number = F.coalesce("doc_id", F.lit(lowest))
    cuts = rows.agg(F.percentile_approx(number, [k / shards for k in range(1, shards)], 10 * shards)).first()[0]
    bounds = np.array(cuts or [], np.int64)
    shared = spark.sparkContext.broadcast((data, bounds))  # bounded: dictionary_size and one number a shard

    @F.pandas_udf("shard int, n long, frame binary")
    def packed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer.value)
        data, bounds = shared.value
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data)).compress
        for ids, texts in parts:
            counts, frames = [], []
            for own in serialized(encoder, texts):
                counts.append(len(own) // width)
                frames.append(compress(own))
            shard, end_shard = np.searchsorted(bounds, ids.to_numpy(), side="left"), np.searchsorted(bounds, ids.to_numpy(), side="right")
            spread = np.array([zlib.crc32(frame) for frame in frames], np.int64)  # an id that several cuts fall on fills their shards
            shard = shard + spread % np.maximum(1, end_shard - shard)
            yield pd.DataFrame({"shard": shard.astype("int32"), "n": np.array(counts, np.int64), "frame": pd.Series(frames, dtype=object)})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        shard, block, first, size = None, 0, 0, 0

        def row() -> pd.DataFrame:
            frames, counts = [x[2] for x in held], [x[1] for x in held]
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            return pd.DataFrame([(shard, block, name, first, [x[0] for x in held], counts, offsets, b"".join(frames))], columns=["shard", "block", "dictionary_hash", "first", "doc_ids", "counts", "offsets", "frames"])

        for batch in batches:
            ids = [None if x is None or x != x else int(x) for x in batch["doc_id"].astype(object)]
            for doc_id, at, n, frame in zip(ids, batch["shard"].tolist(), batch["n"].tolist(), batch["frame"]):
                if held and (at != shard or size >= block_bytes):
                    yield row()
                    block, first = block + 1, first + sum(x[1] for x in held)
                    held, size = [], 0
                if at != shard:
                    shard, block, first = at, 0, 0
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield row()

    encoded = rows.select("doc_id", packed(number, "text").alias("x")).select("doc_id", "x.*")
    dealt = encoded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("frame"))
    dealt.mapInPandas(blocks, _BLOCK).write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n_docs"), F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a few rows for each shuffle partition
    totals.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian unsigned 32 bit) of every document."""
    said = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((said.hash, bytes(said.data), said.width))
    bases = spark.read.parquet(f"{path}/shards").select("shard", F.col("first").alias("base"))
    rows = spark.read.parquet(f"{path}/blocks").join(bases, "shard").select("dictionary_hash", (F.col("base") + F.col("first")).alias("first"), "doc_ids", "counts", "offsets", "frames")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, data, width = shared.value
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress
        for batch in batches:
            for row in batch.itertuples():
                if row.dictionary_hash != name:
                    raise ValueError(f"this block needs dictionary {row.dictionary_hash}; the store has {name}")
                counts = np.asarray(row.counts, np.int64)
                starts = row.first + np.cumsum(counts) - counts
                frames = memoryview(row.frames)
                ids = [np.frombuffer(expand(frames[a:b]), f"<u{width}").astype("<u4").tobytes() for a, b in zip(row.offsets[:-1], row.offsets[1:])]
                yield pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "start": starts, "ids": pd.Series(ids, dtype=object)})

    return rows.mapInPandas(documents, "doc_id long, start long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the rows of one document: only the blocks that hold it are read, and only its frames are decompressed."""
    said = spark.read.parquet(f"{path}/dictionary").first()
    found = []
    holders = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    for row in holders.select("doc_ids", "offsets", "frames").toLocalIterator():
        for k, own in enumerate(row.doc_ids):
            if own == doc_id:
                frame = bytes(row.frames[row.offsets[k] : row.offsets[k + 1]])
                found.append(np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(said.data))).decompress(frame), f"<u{said.width}").astype(np.uint32))
    return found


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of each document's ids."""
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return stored.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read_store(spark, path))
