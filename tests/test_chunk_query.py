"""The chunk query against packing spelled out in plain loops."""

import random
import re

import pandas as pd

from gleanery.plans import catalogue

SIZE, OVERLAP = 400, 50


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text)) + 2


def runs(text):
    """(first line, last line, text) of runs of lines that are not blank, 50 at most."""
    found, run = [], []
    for number, line in enumerate(text.split("\n") + [""], 1):
        if line.strip():
            run.append((number, line))
        if run and (not line.strip() or len(run) == 50):
            found.append((run[0][0], run[-1][0], "\n".join(x for _, x in run).strip()))
            run = []
    return found


def parts(run, head):
    """The run, or as much of it as fits at a time, from a word of the overlap on."""
    first, last, text = run
    if tokens(head + text) <= SIZE:
        return [run]
    found, start = [], 0
    while start < len(text):
        if text[start].isspace():
            start += 1
            continue
        end = start
        while end < len(text) and tokens(head + text[start : end + 1]) <= SIZE:
            end += 1
        end = max(end, start + 1)
        if end < len(text):
            gap = max((m.start() for m in re.finditer(r"\s+", text[start:end])), default=0)
            end = start + gap if gap > int(0.6 * (end - start)) else end
        height = last - first
        found.append((first + int(height * start / len(text)), first - int(-height * end // len(text)), text[start:end].strip()))
        if end >= len(text):
            break
        back = end
        while back - 1 > start and tokens(text[back - 1 : end]) <= OVERLAP:
            back -= 1
        space = text.find(" ", back)
        following = space + 1 if back <= space < end else back
        start = following if following > start else end
    return found


def chunks(doc, text):
    head = f"Path: {doc}.txt\nFile: {doc}.txt\nFormat: text\n\n"
    all_parts = [p for run in runs(text) for p in parts(run, head)]
    made, first = [], 0
    joined = lambda a, b: "\n\n".join(p[2] for p in all_parts[a:b])
    while first < len(all_parts):
        last = first + 1
        while last < len(all_parts) and tokens(head + joined(first, last + 1)) <= SIZE:
            last += 1
        own = all_parts[first:last]
        made.append((doc, len(made), min(p[0] for p in own), max(p[1] for p in own), head + joined(first, last)))
        if last == len(all_parts):
            break
        back, room = last, OVERLAP
        while back - 1 > first and tokens(all_parts[back - 1][2]) <= room:
            room -= tokens(all_parts[back - 1][2])
            back -= 1
        first = back
    return made


def test_chunks_of_documents(spark, tmp_path):
    import hashlib

    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choice(["heat", "of", "lamps,", "naïve", "x" * 30, "river"]) for _ in range(n))
    texts = ["", None, "one line", "\n\n \n", prose(1500), "\n".join(prose(12) for _ in range(140)), "\n\n".join(prose(draw.randrange(1, 90)) for _ in range(25)), prose(700) + "\n" + prose(3) + "\n\n" + prose(600), "y" * 9000]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "file_id": "clash"})
    rows.to_parquet(tmp_path / "documents.parquet")
    found = catalogue.queries()["chunk_documents"](spark, str(tmp_path)).collect()
    assert all(r.last_error is None for r in found)
    got = sorted((r.doc_id, r.ordinal, r.start_line, r.end_line, r.text_md5) for r in found if r.ordinal is not None)
    want = sorted((d, o, a, b, hashlib.md5(t.encode()).hexdigest()) for doc, text in enumerate(texts) for d, o, a, b, t in chunks(doc, text or ""))
    assert got == want and len(want) > 20
    assert all(r.tokens <= 512 for r in found if r.ordinal is not None)
