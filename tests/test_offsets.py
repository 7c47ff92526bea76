"""Places before and after normalization, and scripts whose brackets do not close."""

import random

from gleanery.index import extracted
from gleanery.operators import offsets


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")


def units16(text):
    return text.encode("utf-16-le")


def test_mixed_line_ends(spark):
    rows = offsets.line_places(files(spark, ["alpha\r\nbeta\rgamma\n", "", None])).orderBy("file_id", "line").collect()
    assert [(r.file_id, r.line, r.text, r.start, r.end, r.origin) for r in rows] == [
        (0, 1, "alpha", 0, 5, 0), (0, 2, "beta", 6, 10, 7), (0, 3, "gamma", 11, 16, 12), (0, 4, "", 17, 17, 18), (1, 1, "", 0, 0, 0), (2, 1, "", 0, 0, 0),
    ]
    asked = spark.createDataFrame([(0, 6, 10, "a"), (0, -20, 999, "b"), (0, 6, 6, "c"), (0, 5, 2, "d"), (1, -20, 50, "e"), (9, 0, 1, "f")], "file_id long, start long, end long, name string")
    found = {r.name: (r.start_line, r.end_line, r.original_start, r.original_end) for r in offsets.original_ranges(asked, offsets.line_places(files(spark, ["alpha\r\nbeta\rgamma\n", ""]))).collect()}
    assert found == {"a": (2, 2, 7, 11), "b": (1, 3, 0, 18), "c": (2, 1, 7, 7), "d": (1, 1, 5, 5), "e": (1, 1, 0, 0)}


def test_round_trip(spark):
    """What lies between two places is the same text in both, but for its line ends."""

    for seed in range(3):
        draw = random.Random(seed)
        texts = ["".join(draw.choice("ab \r\r\n\né中\U0001f680") for _ in range(draw.randint(0, 60))) for _ in range(60)]
        normal = ["\n".join(t.replace("\r\n", "\n").split("\r")) for t in texts]
        asked = []
        for k, t in enumerate(normal):
            a, b = sorted(len(units16(t[: draw.randint(0, len(t))])) // 2 for _ in range(2))
            asked.append((k, a, b))
        ranges = spark.createDataFrame(asked, "file_id long, start long, end long")
        for r in offsets.original_ranges(ranges, offsets.line_places(files(spark, texts))).collect():
            part = units16(texts[r.file_id])[2 * r.original_start : 2 * r.original_end].decode("utf-16-le", "surrogatepass")
            whole = units16(normal[r.file_id])
            assert part.replace("\r\n", "\n").replace("\r", "\n") == whole[2 * r.start : 2 * r.end].decode("utf-16-le")
            assert r.start_line == whole[: 2 * r.start].decode("utf-16-le").count("\n") + 1


def test_bytes_to_text(spark):
    cases = [
        (b"plain \xc3\xa9", "plain é", False), (b"\xef\xbb\xbfmark", "mark", False), ("﻿zwölf 🚀".encode("utf-16-le"), "zwölf 🚀", False), ("﻿zwölf".encode("utf-16-be"), "zwölf", False),
        (b"a\xffb\xc3", "a�b�", True), (b"\xff\xfea\x00\x00\xd8b\x00", "a�b", True), (b"", "", False),
    ]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, bytearray(c[0])) for k, c in enumerate(cases)], "k int, content binary").select("k", offsets.decoded(F.col("content")).alias("d")).orderBy("k").collect()
    assert [(r.d.text, r.d.replaced) for r in rows] == [c[1:] for c in cases]
    told = spark.createDataFrame([("a\rb", True), ("a\nb", False)], "t string, r boolean").select(offsets.warnings(F.col("t"), F.col("r")).alias("w")).collect()
    assert [r.w for r in told] == [["INVALID_UNICODE_REPLACED", "LINE_ENDINGS_NORMALIZED"], []]


def balanced_by_stack(text):
    pairs, stack, k, quote = {")": "(", "]": "[", "}": "{"}, [], 0, ""
    while k < len(text):
        c, two = text[k], text[k : k + 2]
        if quote:
            k += 1 if c == "\\" else 0
            quote = "" if c == quote else quote
        elif two == "//":
            k = text.find("\n", k) if "\n" in text[k:] else len(text)
            continue
        elif two == "/*":
            if "*/" not in text[k + 2 :]:
                return False
            k = text.find("*/", k + 2) + 2
            continue
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            stack.append(c)
        elif c in pairs and (not stack or stack.pop() != pairs[c]):
            return False
        k += 1
    return not stack and not quote


def test_balance_against_a_stack(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice(["(", ")", "[", "]", "{", "}", "()", "[{}]", '"', '"{"', "'\\''", "`", "x", "\n", "// (\n", "/* [ */", "/*"]) for _ in range(draw.randint(0, 7))) for _ in range(1500)]
    texts += ['"' + "\\n" * 50_000 + '(" ()', "(" * 20_000 + ")" * 20_000, "([)]", "}{"]
    found = {r.file_id for r in offsets.unbalanced(files(spark, texts)).collect()}
    assert found == {k for k, t in enumerate(texts) if not balanced_by_stack(t)}


def test_scripts_that_do_not_close_fall_back(spark):
    good, bad = "function one() {\n  return '}';\n}\nclass Two {}\n", "function one() {\n  return 1;\nclass Two {}\n"
    rows = spark.createDataFrame([("good", "typescript", good), ("bad", "javascript", bad)], "file_id string, format string, text string")
    found = {(r.file_id, r.kind, r.symbol) for r in extracted(rows).collect()}
    assert found == {("good", "declaration", "one"), ("good", "declaration", "Two"), ("bad", "code", None)}
