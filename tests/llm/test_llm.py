"""The operators of the llm package against brute force, the public libraries, round trips and held-out rows."""

import json
import math
import random
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import bpe, graph_dedup, language_id, mixing, quantized_search, sharding, simhash, token_counts, token_store, toxicity
from gleanery.llm.components import components
from gleanery.llm.common import sampled_by_group
from gleanery.llm.prefix import in_order, running_totals, spread_key

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string"


def texts():
    draw = random.Random(4)
    signs = list("ab cd  \n\t'sSt ll09²½éñ中字　 \xa0\x1c\x85​🙂.,!?-") + ["<|endoftext|>", "aaa", "the "]
    return ["", " ", "a", "'s", "word " * 4000, "x" * 5000, "a\n \nb", "a  b", "trailing  ", "  leading"] + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(400)]


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def mixed_rows():
    own = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts())]
    return [*own, (None, "no id", None, None), (7, own[7][1], None, None), (7, own[7][1], None, None), (5000, None, "en", None)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}), Tokenizer.from_file(JSON)


def test_minimal_perfect_hash():
    for keys in ([], [b"a"], [b"%d" % k for k in range(1000)]):
        table = bpe.MinimalPerfectHash(keys) if keys else None
        assert table is None or sorted(map(table.slot, keys)) == list(range(len(keys)))


def test_bpe_as_the_library(spark, mixed_rows, library):
    docs = documents(spark, mixed_rows)
    sha = lambda b: __import__("hashlib").sha256(b).hexdigest()
    expect = []
    for i, text, _, _ in mixed_rows:
        ids = np.array(library[0].encode_ordinary(text or ""), "<u4")
        expect.append((i, len(ids), sha(ids.tobytes()), sha((text or "").encode())))
    found = [tuple(r) for r in bpe.encode_decode_digests(docs, RANKS).collect()]
    assert sorted(found, key=str) == sorted(expect, key=str)
    back = docs.select(F.col("text"), bpe.token_text(spark, bpe.token_ids(spark, F.col("text"), RANKS), RANKS).alias("bytes")).collect()
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back)
    assert bpe.encode_decode_digests(docs.limit(0), RANKS).count() == 0


def test_token_counts_as_the_library(spark, mixed_rows, library):
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(documents(spark, mixed_rows), JSON).collect()), key=str)
    expect = []
    for i, text, _, _ in mixed_rows:
        n = len(library[1].encode(text or "", add_special_tokens=False).ids)
        expect.append((i, len((text or "").encode()), n, n > 1024))
    assert found == sorted(expect, key=str)


def test_token_store_round_trip(spark, mixed_rows, library, tmp_path):
    docs, path = documents(spark, mixed_rows), str(tmp_path / "store")
    token_store.write_store(docs, path, JSON)
    found = [tuple(r) for r in token_store.digests(token_store.read_store(spark, path)).collect()]
    rows = []
    for i, text, _, _ in mixed_rows:
        ids = np.array([*library[1].encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rows.append((i, len(ids), zlib.crc32(ids.tobytes())))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, expect = 0, []
    for i, n, crc in rows:
        expect.append((i, at, n, crc))
        at += n
    assert sorted(found, key=lambda r: r[1]) == expect
    assert [x.tolist() for x in token_store.read_document(spark, path, 4)] == [[*library[1].encode(mixed_rows[4][1], add_special_tokens=False).ids, 0]]
    token_store.write_store(docs.limit(0), str(tmp_path / "none"), JSON)
    assert token_store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(1, 60)] + [(200, 100), (100, 300), (5, 5), (None, 4)], "x long, y long")
    found = {r.node: r.root for r in components(links, "x", "y").collect()}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert components(links.limit(0), "x", "y").count() == 0


def brute_fingerprint(text):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    return [next(iter([r for r in [k] if up[r] == r]), None) if up[k] == k else roots_of(up, k) for k in range(n)]


def roots_of(up, k):
    while up[k] != k:
        k = up[k]
    return k


def test_simhash_against_brute_force(spark):
    draw = random.Random(9)
    base = [" ".join(f"w{draw.randrange(3000)}" for _ in range(300)) for _ in range(12)]
    near = [" ".join(w if draw.random() > 0.004 else "edit" for w in t.split()) for t in base for _ in range(20)]
    rows = [(k, t, "en", "s") for k, t in enumerate([*base, *near, base[0].upper(), base[0], None, "", " \n", "one two", "One TWO"])]
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    root = roots(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    docs = documents(spark, rows)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {k: (f"{prints[k]:016x}", root[k]) for k in range(len(rows))}
    # tiles of a hot key: the same links, however small the tiles
    small = simhash.close_links(docs.select(simhash.fingerprint(F.col("text")).alias("fp")).distinct(), tile=4)
    joined = {r.node: r.root for r in components(small, "a", "b").collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert all((joined.get(signed[a], signed[a]) == joined.get(signed[b], signed[b])) == (root[a] == root[b]) for a, b in combinations(range(len(rows)), 2))
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(root))


def test_simhash_without_ids_or_rows(spark):
    rows = [(None, "same words here again", "en", "s"), (None, "same words here again", "en", "s"), (3, "same words here again", "en", "s"), (3, "same words here again", "en", "s")]
    docs = documents(spark, rows)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(None, 3), (3, 3)}
    assert simhash.near_duplicates(docs).count() == 4 and simhash.keep_one(docs).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_keeps_rows_not_ids(spark):
    draw = random.Random(16)
    one, other, third = (" ".join(f"w{draw.randrange(3000)}" for _ in range(200)) for _ in range(3))
    rows = [(7, one, "en", "s"), (7, other, "en", "s"), (8, one, "en", "s"), (None, third, "en", "s"), (None, third.upper(), "en", "s")]
    kept = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(7, one), (7, other), (None, third)], key=str)


def speech(draw, syllables, n):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))


TONGUES = {"aa": ["the", "ing", "an", "er", "st"], "bb": ["ße", "ung", "ich", "eä", "sch"], "cc": ["ção", "os", "ña", "que", "ll"]}


def test_language_id(spark):
    draw = random.Random(2)
    rows = [(k, speech(draw, TONGUES[lang], draw.randint(5, 60)), lang, "s") for k, lang in enumerate(draw.choices(list(TONGUES), k=400))]
    rows += [(900, None, "aa", "s"), (901, "12 34 !!", "aa", "s"), (902, "", None, "s"), (None, rows[0][1], None, None), (3, rows[3][1], rows[3][2], "s")]
    found = language_id.identify_languages(documents(spark, rows)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    said = {r.doc_id: r for r in found}
    assert {said[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert all(said[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(400))
    right = [said[k].lang_pred == rows[k][2] for k in range(400) if said[k].held_out]
    assert len(right) > 50 and np.mean(right) > 0.97
    docs = documents(spark, rows)
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(said) - {900, 901, 902}
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_known_languages_are_kept_by_their_distance(spark):
    draw = random.Random(17)
    clean = [(k, speech(draw, TONGUES[lang], draw.randint(5, 60)), lang, "s") for k, lang in enumerate(draw.choices(list(TONGUES), k=200))]
    junk = [(900, speech(draw, ["жщ", "ъы", "цю"], 80), None, "s"), (901, "12 34", "aa", "s")]
    docs = documents(spark, clean + junk)
    assert {r.doc_id for r in language_id.keep_known(docs).collect()} == set(range(200))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_known(unlabelled).collect()} == {*range(200), 900}


def test_toxicity_gradients():
    s = toxicity.Settings(buckets=64, embedding_buckets=16, hidden=3, attention=3)
    net = toxicity.Network(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, stats = toxicity.Words([b"abcdef", b"xyzzy", b"q", b"hello"], s), np.random.default_rng(0).standard_normal((4, 3))
    index, mask, label = np.array([[0, 1, 2, 3], [2, 3, 1, 0]]), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], float), np.array([1.0, 0.0])
    found, _ = net.gradients(words, net.inputs(words, stats), index, mask, label)

    def loss():
        score = 1 / (1 + np.exp(-net.logits(*net.gates(net.inputs(words, stats)), index, mask)[0]))
        return -(label * np.log(score) + (1 - label) * np.log(1 - score)).mean()

    for name, value in net.p.items():
        for at in list(np.ndindex(value.shape))[:12]:
            kept = value[at]
            value[at] = kept + 1e-3
            high = loss()
            value[at] = kept - 1e-3
            low = loss()
            value[at] = kept
            assert found[name][at] == pytest.approx((high - low) / 2e-3, abs=2e-5)


def test_windows_cover_every_word():
    for n in (1, 5, 63, 64, 65, 200, 1001):
        owner, start, size = toxicity.windows([n, 0, n], 64, 48)
        for k, base in ((0, 0), (2, n)):
            held = {w for o, a, b in zip(owner, start, size) if o == k for w in range(a - base, a - base + b)}
            assert held == set(range(n))
        assert 1 not in owner


def test_toxicity(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        words = speech(draw, TONGUES["aa"], draw.randint(10, 150)).split()
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words.insert(draw.randrange(len(words)), draw.choice(["grumble", "snarlish", "vexing"]))
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, "snarlish grumble vexing words", None, None), (5, rows[5][1], "en", "s"), (902, "the grumble " * 3000, "en", "s")]
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (4444, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    said = {r.doc_id: r for r in found}
    held = [k for k in range(400) if said[k].held_out]
    assert all(zlib.crc32(str(k).encode()) % 5 == 0 for k in held)
    assert np.mean([said[k].predicted == labels[k][2] for k in held]) > 0.95
    assert said[900].score == said[901].score == 0 and said[902].predicted == 1
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in said.items() if r.predicted == 0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}


def test_running_totals(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice(["a", "a", "a", "b", None]), draw.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, v long").withColumn("key", spread_key("k"))
    found = running_totals(df, ["g"], "key", "v", "before", 3000, ("k",), 16).toPandas()
    for _, part in found.groupby(found.g.fillna("-")):
        part = part.sort_values(["key", "k"])
        assert (part.before.to_numpy() == np.r_[0, part.v.cumsum().to_numpy()[:-1]]).all()


def test_mixing(spark):
    draw = random.Random(6)
    rows = [(k, " ".join(["w"] * draw.randint(0, 60)), "en", draw.choice(["s0"] * 5 + ["s1", "s2", "s3", None])) for k in range(600)]
    rows += [(None, "a b c", None, "s1"), (4, rows[4][1], "en", rows[4][3]), (700, None, "en", "s2"), (701, "", "en", "only-empty")]
    docs = documents(spark, rows)
    found = mixing.mix(docs).toPandas()
    size = {s: sum(len((t or "").split()) for _, t, _, q in rows if q == s) for s in {r[3] for r in rows}}
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(size.values())
    while open_:  # pour, stop what is full, pour again
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weight[s]}
        target |= {s: 3.0 * size[s] if s in full else level * weight[s] for s in (full or open_)}
        rest -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    source = pd.Series({r[0]: r[3] for r in rows if r[0] is not None})
    own = found[found.doc_id.notna()].assign(source=lambda x: x.doc_id.astype(int).map(source))
    for s in names:
        part = own[own.source.isna() if s is None else own.source == s]
        assert np.allclose(part.target, target[s]) and (part.source_size == size[s]).all()
    assert (found.taken <= 3 * found["size"]).all() and abs(found.taken.sum() - sum(target.values())) <= len(names)
    assert found.position.dropna().is_monotonic_increasing and len(found) == len(rows)
    again = mixing.mix(docs.repartition(7)).toPandas()
    listed = lambda df: sorted(str(tuple(r)) for r in df[["doc_id", "size", "taken"]].itertuples(index=False))
    assert listed(found) == listed(again)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == int(found.exposures.map(len).sum())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_sharding(spark):
    draw = random.Random(8)
    rows = [(k, draw.choice(["hot text"] * 3 + [f"t{draw.randrange(400)}"] * 3 + [f"only {k}"] * 3), "en", "s") for k in range(2000)]
    rows += [(None, "hot text", None, None), (5, rows[5][1], "en", "s"), (3000, None, "en", "s"), (3001, None, "en", "s")]
    found = sharding.shard_documents(documents(spark, rows)).toPandas()
    counts = found.groupby("shard").size()
    assert len(found) == len(rows) and set(found.shard) == set(range(24)) and counts.max() - counts.min() <= 1
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in found.groupby("shard")) and found.grown_shard.isna().all()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    known = found[found.doc_id.notna()].assign(text=lambda x: x.doc_id.astype(int).map(text))
    assert (known["size"] == [8 + len((t or "").encode()) for t in known.text]).all() and (known.text_crc32 == [zlib.crc32((t or "").encode()) for t in known.text]).all()
    spread = known[known.text != "hot text"].dropna(subset="text").groupby("text").shard.nunique()
    assert (spread > 1).mean() < 0.02
    hot = known[known.text == "hot text"]
    assert hot.shard.nunique() <= math.ceil(len(hot) / (len(rows) // 24)) + 8
    assert sharding.shard_documents(documents(spark, rows).limit(0)).count() == 0
    few = sharding.shard_documents(documents(spark, rows[:5])).toPandas()
    assert sorted(few.slot) == [0] * 5 and few.shard.nunique() == 5


def test_sharding_nothing_but_copies(spark):
    sizes = [1600, *[40 + k % 3 for k in range(30)], *[2 + k % 5 for k in range(500)]]
    rows = [(f"t{k}",) for k, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string")
    found = sharding.shard_documents(docs).toPandas()
    counts = found.groupby("shard").size()
    assert len(found) == len(rows) and found.doc_id.nunique() == len(rows) and counts.max() - counts.min() <= 1
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in found.groupby("shard"))
    shards = found.groupby(found.doc_id.map(lambda k: rows[k][0])).shard.nunique()
    assert shards["t0"] <= math.ceil(1600 / counts.min()) + 1
    assert (shards.drop("t0") > 1).sum() <= 24


def test_packing_cuts_only_what_fits_nowhere():
    draw = random.Random(15)
    sizes = {n: draw.randint(1, 20) for n in range(2, 60)} | {700: 1}
    total = sum(n * many for n, many in sizes.items())
    vacant = [total // 24 + (s < total % 24) for s in range(24)]
    whole, cut = sharding._pack(sizes, vacant)
    assert vacant == [0] * 24 and len({c[:2] for c in cut}) <= 24
    for n, many in sizes.items():
        assert sorted([t for size, a, b, _ in whole if size == n for t in range(a, b)] + list({turn for size, turn, *_ in cut if size == n})) == list(range(many))


def vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((40, 16))
    near = np.repeat(base[:6], 30, axis=0) + 0.08 * draw.standard_normal((180, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, near, base[:2], draw.standard_normal((300, 16))]).astype(np.float32))]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (7, rows[7][1])]
    return rows, spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))


def test_vector_dedup_against_brute_force(spark):
    rows, df = vectors(spark)
    v = np.array([r[1] for r in [*rows, rows[7]]], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    ids = [r[0] for r in rows] + [7]
    root = roots(len(rows), [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(near)) if a < b and ids[a] != ids[b]])
    found = graph_dedup.near_duplicate_vectors(df).collect()
    assert len(found) == len(rows) + 7
    for r in found:
        if r.vec_id is None or r.vec_id >= 9000:
            assert r.n_links == 0 and r.component_id == r.vec_id
        else:
            assert (r.n_links, r.component_id, r.kept) == (int(near[r.vec_id].sum()) - 1, root[r.vec_id], root[r.vec_id] == r.vec_id)
    assert graph_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vector_dedup_with_repeated_ids_of_unlike_vectors(spark):
    draw = np.random.default_rng(21)
    one, other = draw.standard_normal((2, 16))
    rows = [(7, one.tolist()), (7, other.tolist()), (9, (other + 0.01 * draw.standard_normal(16)).tolist()), (11, (one * 2).tolist()), (12, one[:4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in graph_dedup.near_duplicate_vectors(df).collect())
    assert found == [(7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (11, 1, 7, False), (12, 0, 12, True)]


def test_vector_dedup_over_several_shards_and_blocks(spark):
    rows, df = vectors(spark)
    v = graph_dedup.unit(np.array([r[1] for r in rows]))
    near = v @ v.T >= 0.9
    root = roots(len(rows), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    small = graph_dedup.Settings(shard_floats=16 * 100, block_rows=15, tasks=7)
    found = graph_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), settings=small).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(k, int(near[k].sum()) - 1, root[k]) for k in range(len(rows))}
    assert all(r.recall >= 0.99 for r in found)


def linked_rows(shard, v):
    """vec_id -> links, and the pairs that unite, of all rows of a shard of one copy each."""
    found = pd.concat([shard.links(np.arange(k, min(k + 500, len(v))), v[k : k + 500]) for k in range(0, len(v), 500)])
    own = found[found.id.notna()]
    return own.groupby("id").linked.sum().to_dict(), roots(len(v), [(int(a), int(b)) for a, b in zip(own.id, own.root) if a != b]), found[found.id.isna()]


def brute_links(v):
    near = v @ v.T >= 0.9
    return {k: int(n) - 1 for k, n in enumerate(near.sum(axis=1))}, roots(len(v), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])


@pytest.mark.parametrize("spread", [0.05, 0.09, 0.14])
def test_graph_finds_what_is_near(spread):
    draw = np.random.default_rng(11)
    v = graph_dedup.unit(np.concatenate([draw.standard_normal((2000, 24)), np.repeat(draw.standard_normal((4, 24)), 160, axis=0) + spread * 2 * draw.standard_normal((640, 24))]))
    shard = graph_dedup.Shard(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.9, graph_dedup.Settings())
    links, root, audit = linked_rows(shard, v)
    assert (links, root) == brute_links(v)
    assert shard.graph.reached()[shard.nodes].all() and len(shard.nodes) < len(v)
    assert (audit.found / audit.audited >= 0.99).all()
    again = graph_dedup.Shard.unpacked(shard.packed(), 0.9, graph_dedup.Settings())
    assert linked_rows(again, v)[:2] == (links, root)


def test_links_are_rows_of_queries_not_of_pairs():
    draw = np.random.default_rng(22)
    v = graph_dedup.unit(draw.standard_normal(32) + 0.03 * draw.standard_normal((3000, 32)))  # one group: millions of pairs
    shard = graph_dedup.Shard(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.9, graph_dedup.Settings())
    found = shard.links(np.arange(len(v)), v)
    assert len(found) <= 2 * len(v) + 1 and set(found[found.linked > 0].linked) == {len(v) - 1} and len(shard.nodes) < 10


def test_beams_widen_until_the_audit_passes(monkeypatch):
    draw = np.random.default_rng(13)
    base = draw.standard_normal((900, 24))
    v = graph_dedup.unit(np.concatenate([base, base[:300] + 0.05 * draw.standard_normal((300, 24))]))
    shard = graph_dedup.Shard(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.99, graph_dedup.Settings(beam=2))
    whole, beams = shard.graph.search, []

    def blind(queries, beam, bottom=0):  # narrow beams see half of what there is
        beams.append(beam)
        ids, sims = whole(queries, beam, bottom)
        gone = (beam < 64) & (ids % 2 == 0)
        return np.where(gone, -1, ids), np.where(gone, -np.inf, sims)

    monkeypatch.setattr(shard.graph, "search", blind)
    links, _, audit = linked_rows(shard, v)
    near = v @ v.T >= 0.99
    assert max(beams) >= 64 and links == {k: int(n) - 1 for k, n in enumerate(near.sum(axis=1))}
    assert (audit.audited > 200).all()


def test_nodes_out_of_reach_are_linked(monkeypatch):
    draw = np.random.default_rng(14)
    v = graph_dedup.unit(draw.standard_normal((600, 24)))
    link = graph_dedup.Graph._spread_links

    def cut_first(self):
        for near in self.near:
            near[np.isin(near, np.arange(300, 420))] = -1
        self.near[0][:, self._width(0) : self._width(0) + 11] = self.entry  # all but one spare place is taken
        link(self)

    monkeypatch.setattr(graph_dedup.Graph, "_spread_links", cut_first)
    graph = graph_dedup.Graph(v, graph_dedup.Settings(known_by=0))
    assert graph.reached().all()
    assert (graph.search(v, 96)[0] == np.arange(600)[:, None]).any(axis=1).mean() > 0.98


def test_nearest_vectors_recall(spark):
    rows, df = vectors(spark)
    found = quantized_search.nearest_vectors(df, F.pmod(F.col("vec_id"), F.lit(5)) == 0).toPandas()
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores = v @ v.T
    np.fill_diagonal(scores, -2)
    hit = 0
    for q in range(0, len(rows), 5):
        own = found[found.query_id == q].sort_values("rank")
        best = np.lexsort((np.arange(len(rows)), -scores[q]))[:5]
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        assert np.allclose(own.score, scores[q][own.vec_id], atol=1e-12)
        hit += len(set(best) & set(own.vec_id))
    assert hit / (5 * len(range(0, len(rows), 5))) >= 0.9
    assert quantized_search.nearest_vectors(df.limit(0), F.lit(True)).count() == 0
    two = df.where("vec_id in (1, 2)")
    assert [(r.query_id, r.vec_id) for r in quantized_search.nearest_vectors(two, F.col("vec_id") == 1).collect()] == [(1, 2)]


def test_nearest_within_a_large_group_of_near_copies():
    draw = np.random.default_rng(12)
    vectors = draw.standard_normal((4096, 64))
    vectors[::3] = vectors[0] + draw.uniform(0.02, 0.2, (1366, 1)) * draw.standard_normal((1366, 64))
    held, ids = quantized_search.unit(vectors), np.arange(4096)
    shard = quantized_search.QuantizedShard(quantized_search.Codebook(held, quantized_search.Settings()), ids, vectors)
    asked = np.r_[0:300:3, 1:300:30]
    found = shard.nearest(ids[asked], vectors[asked], 5)
    for q, part in found.groupby("query_id"):
        exact = held @ held[q]
        exact[q] = -np.inf
        assert part.vec_id.tolist() == np.argsort(-exact, kind="stable")[:5].tolist()
    assert found.groupby("query_id").size().to_dict() == {q: 5 for q in asked}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(12)
    base = [(k, speech(draw, TONGUES["aa"], draw.randint(30, 90)), "aa", f"s{k % 4}", None) for k in range(60)]
    rows = base + [(100 + k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(base[:10])] + [(300, "123 456", "aa", "s0", None), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, name)
        seen[name] = [r.doc_id for r in docs.collect()]
    assert set(seen["language_id"]) == {r[0] for r in rows} - {300, 301}
    assert sorted(seen["simhash_dedup"]) == list(range(60))
    assert max(seen["mixing"].count(k) for k in set(seen["mixing"])) <= 3 and set(seen["mixing"]) <= set(range(60))
    assert sorted(seen["byte_bpe"]) == sorted(seen["mixing"])
    found = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == sorted((r.doc_id, r.n_tokens) for r in docs.collect())


def test_books_of_few_pieces_change_nothing(mixed_rows, library):
    encoder = token_store.LibraryEncoder(open(JSON, encoding="utf-8").read(), capacity=3)
    some = [t or "" for _, t, _, _ in mixed_rows]
    expect = [np.array(library[1].encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in some]
    assert list(encoder.encode(some)) == expect and list(encoder.encode(some[::-1])) == expect[::-1]
    assert all(len(book) <= 3 + 8000 for book in encoder.books)


def test_library_is_asked_once_for_a_pretoken():
    encoder = token_store.LibraryEncoder(open(JSON, encoding="utf-8").read())
    asked, tokenize = [], encoder._tokenize
    encoder._tokenize = lambda letters: asked.append(letters) or tokenize(letters)
    some = [" ".join(f"{word}{end}" for word in ("ab", "é", "cd-ef", "99") for end in ("", ",", ".", "!\n", "'s", "...")) for _ in range(2)]
    list(encoder.encode(some)), list(encoder.encode([*some, "new, ab"]))
    assert len(asked) == len(set(asked)) > 10


def test_special_strings_of_letters_or_with_spaces(mixed_rows):
    said = json.loads(open(JSON, encoding="utf-8").read())
    for special in ("abc", "a b", "é"):
        said["added_tokens"][0]["content"] = special
        library, encoder = Tokenizer.from_str(json.dumps(said)), token_store.LibraryEncoder(json.dumps(said))
        for text in ("xabcx abc, a b  abc", "abc", "é aé bé a b", *(t or "" for _, t, *_ in mixed_rows[:100])):
            assert list(encoder.encode([text])) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]


def test_pretokens_of_many():
    import regex

    from gleanery.llm.pieces import pretokens_of_many

    draw, find = random.Random(33), regex.compile(public_tokenizers.PATTERN).findall
    signs = list("ab  \n\t\r'stlvredmAZ09.,-_é×÷ÀɏĿ\0\x1cª²½中\u200b\u0301") + ["'s", "'ll", " \n", "\n "]
    pieces = ["", *("".join(draw.choice(signs[: draw.choice((24, 40))]) for _ in range(draw.randint(0, 9))) for _ in range(20_000))]
    expect = [find(piece) for piece in pieces]
    assert pretokens_of_many(pieces, find) == expect and [pretokens_of_many([piece], find)[0] for piece in pieces] == expect


def test_uneven_white_space_is_seen():
    from gleanery.llm.pieces import _UNEVEN, _uneven

    draw = random.Random(31)
    signs = " ab\n\t\x1c\x85\xa0é中　"
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 8)))
        assert _uneven(text) == (_UNEVEN.search(text) is not None)


def test_in_order(spark):
    draw = random.Random(32)
    rows = [(f"s{draw.randrange(10**6)}" if k else None, draw.randrange(100)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v long")
    found = in_order(df, [F.col("g").asc_nulls_last(), F.col("v")], "place", {"v": "before"}).toPandas().sort_values("place")
    expect = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    assert list(found.place) == list(range(900)) and list(found.v) == [v for _, v in expect] and list(found.before) == np.r_[0, np.cumsum([v for _, v in expect])[:-1]].tolist()
    assert in_order(df.limit(0), [F.col("g")], "place").count() == 0


def test_samples_by_group(spark):
    rows = [(k, "large" if k % 3 else None) for k in range(30_000)] + [(k, "small") for k in range(7)]
    df = spark.createDataFrame(rows, "id long, g string")
    found = sampled_by_group(df, "g", F.when(F.col("g") == "large", 100).otherwise(50))
    assert found.columns == df.columns and {r.g: r.n for r in found.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"large": 100, None: 50, "small": 7}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, sampled_by_group(df.repartition(5), "g", F.when(F.col("g") == "large", 100).otherwise(50)).collect()), key=str)


def test_mixing_through_the_schedule(spark):
    """Positions and exposures against a plain walk along every source's stream."""
    draw = random.Random(33)
    rows = [(k, " ".join(["w"] * draw.randint(0, 40)), "en", f"host{draw.randrange(60):02}") for k in range(900)] + [(900, "word " * 60_000, "en", "host00"), (901, None, None, None)]
    docs = documents(spark, rows)
    sources = mixing.source_targets(docs.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))).alias("source_size"))).toPandas()
    sources = sources.sort_values("source", na_position="last", ignore_index=True)
    mean = (sources.quota * sources.index).sum() / sources.quota.sum()
    assert np.allclose(sources.slope, mixing.RAMP * (sources.index - mean) / (len(sources) - 1)) and abs(sources.quota.sum() - sources.source_size.sum()) <= len(sources)
    found = mixing.mix(docs).toPandas()
    for _, own in found.merge(pd.DataFrame([(r[0], r[3]) for r in rows], columns=["doc_id", "source"])).groupby("source"):
        plan = sources[sources.source == own.source.iloc[0]].iloc[0]
        for row in own.itertuples():
            for x in row.exposures:
                t = x["position"] / sources.quota.sum()  # its share of the integrated schedule is what the stream had taken by then
                place = (t + plan.slope * (t * t - t)) * plan.quota
                assert -1e-6 <= place <= plan.quota and x["words"] == max(0, min(row.size, plan.quota - round(place)))
            assert row.taken == sum(x["words"] for x in row.exposures)


def test_sharding_reports_what_it_cuts(spark):
    draw = random.Random(34)
    sizes = [draw.choice([1, 1, 2, 3, 9]) for _ in range(600)] + [400]
    rows = [(f"t{k}",) for k, n in enumerate(sizes) for _ in range(n)] + [("long words " * 100_000,)] * 2
    docs = spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string")
    report = []
    found = sharding.shard_documents(docs, report=report).toPandas()
    spread = found.groupby([found.doc_id.map(lambda k: rows[k][0]), "shard"]).size()
    cut = int((spread.groupby(level=0).sum() - spread.groupby(level=0).max()).sum())
    assert report[-1]["cut"] == cut and all(a["cut"] > b["cut"] for a, b in zip(report[:-1], report[1:-1]))
    room = len(rows) // 24
    assert cut <= 400 - room + 2 * 24  # the large group fills several shards; hardly another is cut
    assert found[found.doc_id >= len(rows) - 2].shard.nunique() == 1 and found["size"].max() == 8 + len(rows[-1][0])


def test_language_distances_as_written_out(spark):
    draw = random.Random(35)
    profiles = {k: language_id.ranked(language_id.ngrams(speech(draw, own, 400)), 300).tolist() for k, own in TONGUES.items()}
    model = language_id.RankProfiles(profiles, 300)
    for text in [speech(draw, own, draw.randint(1, 60)) for own in TONGUES.values() for _ in range(20)] + ["the " * 200_000]:
        own = language_id.ranked(language_id.ngrams(text), 300).tolist()
        apart = {k: sum(abs(p.index(g) - at) if g in p else 300 for at, g in enumerate(own)) for k, p in profiles.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        assert model.predict(text) == (best, pytest.approx(1 - apart[best] / (300 * len(own))))
    rows = [(k, speech(draw, TONGUES[lang], 30), lang, "s") for k, lang in enumerate(["aa"] * 40 + ["bb"] * 30 + ["cc"] * 10)]
    assert language_id.fit_profiles(documents(spark, rows), max_languages=2).languages == ["aa", "bb"]


def plain_score(net, text):
    """The network written out word by word: every window's gates, states, attention and logit."""
    p, s = net.p, net.settings
    words = toxicity.words_of(text)
    logits = []
    for first in range(0, max(len(words) - (s.window - s.stride), 1), s.stride):
        inputs = []
        for w in words[first : first + s.window]:
            one = toxicity.Words([w], s)
            grams = one.grams.tolist()
            odds = [float(net.grams[g]) for g in grams]
            chars = np.mean([p["gram"][g % s.embedding_buckets] for g in grams], axis=0) if grams else np.zeros(s.embedding)
            inputs.append(np.concatenate([[net.forms[one.form[0]], max(odds, default=0), np.mean(odds) if odds else 0], p["form"][one.form[0] % s.embedding_buckets], chars]))
        sides = []
        for way, line in (("f", inputs), ("b", inputs[::-1])):
            h, own = np.zeros(s.hidden), []
            for x in line:
                g, a, n = x @ p[f"w{way}"] + p[f"c{way}"], h @ p[f"u{way}"], s.hidden
                z, r = (1 / (1 + np.exp(-(g[k * n : (k + 1) * n] + a[k * n : (k + 1) * n]))) for k in (0, 1))
                h = h + z * (np.tanh(g[2 * n :] + r * a[2 * n :]) - h)
                own.append(h)
            sides.append(own if way == "f" else own[::-1])
        states = [np.concatenate(pair) for pair in zip(*sides)]
        energy = np.array([np.tanh(x @ p["wa"] + p["ca"]) @ p["va"] for x in states])
        weight = np.exp(energy - energy.max()) / np.exp(energy - energy.max()).sum()
        logits.append(float(sum(w * x for w, x in zip(weight, states)) @ p["wo"] + p["co"][0]))
    return 1 / (1 + math.exp(-max(logits)))


def toxic_rows(draw, n, lengths, words=("grumble", "snarlish", "vexing")):
    rows, labels = [], []
    for k in range(n):
        own = speech(draw, TONGUES["aa"], draw.randint(*lengths)).split()
        for _ in range(3 * (k % 4 == 0)):
            own.insert(draw.randrange(len(own)), draw.choice(words))
        rows.append((k, " ".join(own), "en", "s"))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, labels


def test_scores_as_written_out():
    draw = random.Random(36)
    rows, labels = toxic_rows(draw, 120, (10, 150))
    net = toxicity.train([r[1] for r in rows], [x[2] for x in labels])
    scorer = toxicity.Scorer(net, capacity=50)
    for text in ["a", "grumble", *(r[1] for r in rows[:12]), rows[0][1] * 5]:
        assert scorer.score([text])[0] == pytest.approx(plain_score(net, text), abs=1e-4)


def test_long_labelled_texts_are_learnt_from(spark):
    draw = random.Random(37)
    rows, labels = toxic_rows(draw, 60, (16_000, 17_000))
    assert min(len(r[1]) for r in rows) > 1 << 16
    found = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in found if not r.held_out]) > 0.9


def test_nearest_vectors_of_several_lengths_and_ties(spark):
    draw = np.random.default_rng(38)
    rows = [(k, draw.standard_normal(8).tolist()) for k in range(100)] + [(200 + k, draw.standard_normal(5).tolist()) for k in range(30)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("id", F.lit("clash"))
    found = quantized_search.nearest_vectors(df, F.col("vec_id").isin(3, 210), settings=quantized_search.Settings(shard_floats=8 * 20)).collect()
    for q in (3, 210):
        own = np.array(dict(rows)[q])
        near = sorted(((-float(np.dot(v, own) / np.linalg.norm(v) / np.linalg.norm(own)), k) for k, v in rows if len(v) == len(own) and k != q))[:5]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [(r, v) for r, v, _ in got] == [(n + 1, k) for n, (_, k) in enumerate(sorted((round(s, 12), k) for s, k in near))] and np.allclose([s for _, _, s in got], [-s for s, _ in near])


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_long_text_does_not_end_the_sample(spark):
    settings = toxicity.Settings(sample_chars=100_000)
    draw = random.Random(3)
    rows = [(k, f"{'you vile idiot' if k % 3 == 0 else 'a calm day'} {draw.choice('abc')} {'filler text ' * 5}", None, None) for k in range(120)]
    early = min((k for k in range(5000, 9000) if zlib.crc32(str(k).encode()) % 5), key=lambda k: zlib.crc32(str(k).encode()))
    docs = documents(spark, [*rows, (early, "long " * 30_000, None, None)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(early, 0)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels, settings).collect()}
    assert sum(found[k] for k in range(0, 120, 3)) >= 36 and sum(found[k] for k in range(120) if k % 3) <= 4


def test_every_language_is_learnt(spark):
    """More languages than documents of any: all have a profile."""
    rows = [(k, chr(0x3041 + k % 80) * 3 + " " + chr(0x4E00 + k % 80) * 3, f"l{k % 80}", None) for k in range(240)]
    profiles = language_id.fit_profiles(documents(spark, rows), docs_per_language=2)
    assert sorted(profiles.languages) == sorted({f"l{k}" for k in range(80)})


def test_store_of_one_id_and_of_long_texts(spark, tmp_path, library):
    """A third of the rows share an id, another third have none: they lie in order over several shards."""
    draw = random.Random(12)
    words = lambda: " ".join(draw.choice(["stone", "river", "cloud", "ember"]) for _ in range(draw.randint(1, 3000)))
    rows = [(None if k % 3 == 0 else 40 if k % 3 == 1 else k, words(), None, None) for k in range(150)]
    token_store.write_store(documents(spark, rows), str(tmp_path / "s"), JSON, sample_chars=500)
    assert spark.read.parquet(str(tmp_path / "s/blocks")).where("first is not null").select("shard").distinct().count() > 8
    found = [tuple(r) for r in token_store.digests(token_store.read_store(spark, str(tmp_path / "s"))).collect()]
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, *_ in found:
        assert start == at
        at += n
    expect = {}
    for i, text, *_ in rows:
        ids = [*library[1].encode(text, add_special_tokens=False).ids, 0]
        expect.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for i, _, n, crc in found:
        got.setdefault(i, []).append((n, crc))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expect.items()}
    assert len(spark.read.parquet(str(tmp_path / "s/dictionary")).first().data) > 0
