"""Divergence of sources against counting everything by hand."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from gleanery.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string, term string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, "v", "r", "t") for k, (t, lang, s) in enumerate(rows)], SCHEMA)


def by_hand(rows, least, best=50):
    of_lang, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups[lang, source].update(words)
        of_lang[lang].update(words)
        documents[lang].update(set(words))
    kept = {lang: [t for t, d in documents[lang].items() if d >= least] for lang, _ in groups}
    share = lambda uses, t, whole: 1 + 1_000_000_000 * (uses[t] + 5) // whole
    size = lambda uses, lang: sum(uses[t] for t in kept[lang]) + 5 * len(kept[lang])
    out = []
    for (lang, source), uses in groups.items():
        p = {t: share(uses, t, size(uses, lang)) for t in kept[lang]}
        pairs = [(sum(abs(p[t] - share(more, t, size(more, lang))) for t in kept[lang]), other) for (l2, other), more in groups.items() if l2 == lang and other != source]
        over = [(p[t] - share(of_lang[lang], t, size(of_lang[lang], lang)), t) for t in kept[lang] if uses[t]]
        for part, found, limit in (("pair", pairs, None), ("term", [x for x in over if x[0] > 0], best)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(6)
    words = ["Alpha", "beta", "ÉTÉ", "été", "中字", "x", "Y", "straße", "gamma", "delta", "w1w", "ſ", "K"] + [f"q{chr(97 + k)}" for k in range(20)]
    lines = lambda: draw.choice([" ", ", ", "\n", "-"]).join(draw.choices(words, k=draw.randint(0, 30)))
    rows = [(lines(), draw.choice(["en", "en", "fr", None]), draw.choice(["s0", "s0", "s0", "s1", "s2", None])) for _ in range(400)]
    return rows + [("", "de", "s1"), (None, "de", "s2"), (None, None, None), ("solo " * 50, "it", "s9"), *[("same text", "en", "s7")] * 40]


@pytest.mark.parametrize("least", [1, 12])
def test_as_counted_by_hand(spark, mixed, least):
    assert rows_of(divergence.source_divergence(table(spark, mixed), least=least, best=7)) == by_hand(mixed, least, 7)


def test_small_blocks_many_runs(spark, mixed):
    expect = by_hand(mixed, 5)
    for capacity, parts in ((1, 3), (40, 9)):
        assert rows_of(divergence.source_divergence(table(spark, mixed).repartition(parts), least=5, capacity=capacity)) == expect


def test_nothing_to_keep(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("", "fr", "x")]
    assert rows_of(divergence.source_divergence(table(spark, rows))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert rows_of(divergence.source_divergence(table(spark, []))) == []


def test_long_texts_are_cut_where_no_term_is():
    text = "Ab é " * 300_000 + "x" * 1_500_000 + " end"
    found = Counter(t for part in divergence.terms(text) for t in part)
    assert found == {b"ab": 300_000, "é".encode(): 300_000, b"x" * 1_500_000: 1, b"end": 1}
    assert list(divergence.terms("")) == []


def test_pages_of_a_run_merge_in_order():
    draw = random.Random(3)
    expect, pages = defaultdict(lambda: defaultdict(lambda: [0, 0])), []
    for number in range(5):
        block = divergence.Block(shards=1, page=4)
        for _ in range(30):
            group = ("en", draw.choice("st"))
            word = draw.choice("abcdefghij")
            block.add(*group, f"{word} {word}")
            expect[word.encode()][group][0] += 2
            expect[word.encode()][group][1] += 1
        for r in block.run(number).to_pylist():
            pages.append((r["first"], list(zip(r["langs"], r["sources"])), r["terms"], r["groups"], r["uses"], r["documents"]))
    found = list(divergence.merged(iter(sorted(pages, key=lambda p: p[0]))))
    assert [t for t, _ in found] == sorted({b"", *expect})
    assert {t: {g: tuple(n) for g, n in groups.items()} for t, groups in found if t} == {t: {g: tuple(n) for g, n in groups.items()} for t, groups in expect.items()}


def test_pairs_in_parts(spark):
    """Sums are given out early without changing their total; terms go on from one batch to the next."""
    draw = random.Random(9)
    rows = [("en", f"t{t}", f"s{s}", draw.randrange(100), 7 + s) for t in range(60) for s in draw.sample(range(12), draw.randint(1, 12))]
    held = spark.createDataFrame(rows, "lang string, term string, source string, p long, rest long")
    expect = Counter()
    for _, own in pd.DataFrame(rows).groupby(1):
        own = own.values.tolist()
        for x in own:
            for y in own:
                if x[2] < y[2]:
                    expect["en", x[2], y[2]] += abs(x[3] - y[3]) - abs(x[3] - y[4]) - abs(x[4] - y[3]) + abs(x[4] - y[4])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for flush in (1, 1 << 20):
            found = Counter()
            for r in divergence.corrections(held, flush).collect():
                found[r.lang, r.a, r.b] += r.amount
            assert {k: v for k, v in found.items() if v} == {k: v for k, v in expect.items() if v}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
