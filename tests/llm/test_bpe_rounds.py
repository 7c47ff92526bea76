"""BPE by merge rounds against the tokenizers library, and the books of pieces that it shares with others."""

import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import bpe, bpe_rounds, pieces, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, ids_sha256 string, found string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def coder():
    return bpe_rounds.RoundsCoder(JSON)


def texts():
    draw = random.Random(8)
    signs = list("ab cd  \n\t'sSt ll09²½éñ中字　 \xa0\x1c\x85​🙂.,!?-") + ["<|endoftext|>", "<|end", "aaa", " the"]
    long = ["".join(draw.choice("abcdefgh") for _ in range(3000)), "a" * 2001, "ab" * 700, "中字语言" * 500, "word " * 3000, "x<|endoftext|>y <|endoftext|>  <|endoftext|>"]
    return ["", " ", "a", *long] + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(500)]


def encoder(coder, capacity=1 << 20):
    return pieces.PieceEncoder(public_tokenizers.PATTERN, coder.encode_many, b"".join, coder.special, capacity)


@pytest.mark.parametrize("capacity", [10, 1 << 20])
def test_ids_and_text_as_the_library(coder, library, capacity):
    held, all_texts = encoder(coder, capacity), texts()
    for part in (all_texts, all_texts[::-1], all_texts):
        for text, packed in zip(part, held.encode(part)):
            expect = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(packed, "<u4").tolist() == expect
            assert coder.decode(np.array(expect)) == library.decode(expect, skip_special_tokens=False) == text


def test_decoding_broken_characters_as_the_library(coder, library):
    draw = random.Random(1)
    for _ in range(200):
        ids = [draw.randrange(50257) if draw.random() < 0.3 else draw.randrange(256) for _ in range(12)]
        assert coder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_both_forms_of_rounds_agree():
    words = [w.encode() for w in set(" ".join(texts()).split())]
    assert bpe_rounds.RoundsCoder(JSON, longest=2).encode_words(words) == bpe_rounds.RoundsCoder(JSON, longest=10**6).encode_words(words)


def test_a_long_word_takes_time_by_its_length(coder, library):
    draw = random.Random(2)
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.process_time()
    ids = np.frombuffer(coder.encode_words([word.encode()])[0], "<u4").tolist()
    assert time.process_time() - began < 20
    assert ids == library.encode(word, add_special_tokens=False).ids


def test_pairs_by_binary_search():
    table = bpe_rounds.MergeTable(*(np.array(x, np.int32) for x in ([5, 1, 1, 5], [2, 9, 0, 2], [7, 8, 6, 7])))
    assert table.ranks(np.array([1, 5, 1, 2]), np.array([0, 2, 9, 5])).tolist() == [2, 0, 1, bpe_rounds._NONE]  # of (5, 2) the lower
    empty = bpe_rounds.MergeTable(*(np.zeros(0, np.int32),) * 3)
    assert empty.ranks(np.array([1]), np.array([1])).tolist() == [bpe_rounds._NONE]


def test_other_kinds_of_files_are_refused(tmp_path):
    said = json.loads(open(JSON, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"model": said["model"] | {"dropout": 0.1}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "other.json").write_text(json.dumps(said | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe_rounds.RoundsCoder(str(tmp_path / "other.json"))


def test_digests_of_documents(spark, library):
    rows = [(k, t, "a", "b", "c") for k, t in enumerate(texts()[:150])] + [(None, "no id", "a", "b", "c"), (3, "twice", "", "", ""), (3, "twice", "", "", ""), (4, None, None, None, None)]
    docs, expect = spark.createDataFrame(rows, SCHEMA), []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_rounds.encode_decode_digests(docs, JSON).collect()), key=str) == sorted(expect, key=str)
    assert bpe_rounds.encode_decode_digests(docs.limit(0), JSON).count() == 0
    back = docs.select("text", bpe_rounds.token_text(spark, bpe_rounds.token_ids(spark, F.col("text"), JSON), JSON).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def kept_bytes(held):
    return sum(len(p.encode()) + (len(v) if isinstance(v, bytes) else 8) for book in (held._tokens, held._plain, held._spaced) for p, v in book.items())


def test_books_are_bounded_in_bytes(coder):
    """Texts without spaces are one piece each: nothing of them stays."""
    draw = random.Random(5)
    plain = bpe.BytePairCoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    counter = token_counts.RankCounter(JSON)
    for many, total in ((coder.encode_many, b"".join), (plain.encode_many, b"".join), (counter.encode_many, sum)):
        held = pieces.PieceEncoder(public_tokenizers.PATTERN, many, total, capacity=1 << 18)
        for _ in range(3):
            held.encode(["".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(3000)) for _ in range(5)])
        assert kept_bytes(held) == 0
        for _ in range(30):
            held.encode([" ".join("".join(draw.choice("abcdef") for _ in range(9)) for _ in range(400))])
            assert kept_bytes(held) < (1 << 18) + 400 * 400
