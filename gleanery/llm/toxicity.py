"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is words; each word enters as a vector of its word form and of its character n-grams. The network reads windows of
`window` words that overlap, and a text's score is its most toxic window's. Training picks, for each labelled text, the window
that now scores highest (the label says that some window is toxic, or that none is).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sampled_by_group, slices, written
from .language_id import remainder

#: ASCII other than letters parts words; bytes of longer characters belong to them.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    window: int = 64  # words
    stride: int = 48  # windows overlap by the rest
    hidden: int = 8  # of each direction
    embedding: int = 4  # learnt numbers of a word form, and of its n-grams
    attention: int = 8
    buckets: int = 1 << 18  # of hashed forms and n-grams with statistics
    embedding_buckets: int = 1 << 13
    grams: tuple[int, ...] = (5, 7, 8)  # bytes, of the word with a mark at either end
    positives: int = 1000  # labelled documents learnt from, at most
    negatives: int = 2000
    sample_chars: int = 1 << 24  # of all documents learnt from, at most; of any length each
    epochs: int = 4
    batch: int = 256
    rate: float = 0.02
    embedding_rate: float = 0.2  # times rate: embeddings learn slowly, lest they learn single documents by heart
    seed: int = 7


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def hashed_grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of `<word>`, and the word that each is of, in the order of the words."""
    line = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for n in sizes:
        if len(line) < n:
            continue
        code = np.full(len(line) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code * np.uint64(0x100000001B3)) ^ line[k : len(line) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        found.append(((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets)
        owners.append(owner[: len(code)][inside])
    grams, owners = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return grams[order], owners[order]


class Words:
    """Hashed forms and n-grams of a list of words."""

    def __init__(self, words: list[bytes], settings: Settings):
        self.form = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % settings.buckets
        self.grams, self.owner = hashed_grams(words, settings.grams, settings.buckets)
        self.counts = np.bincount(self.owner, minlength=len(words))
        self.has = np.flatnonzero(self.counts)
        self.starts = (np.cumsum(self.counts) - self.counts)[self.has]

    def statistics(self, forms: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """For each word: the log-odds of its form, and the largest and the mean of those of its n-grams."""
        out = np.zeros((len(self.form), 3), np.float32)
        out[:, 0] = forms[self.form]
        if len(self.grams):
            value = grams[self.grams]
            out[self.has, 1] = np.maximum.reduceat(value, self.starts)
            out[self.has, 2] = np.add.reduceat(value, self.starts) / self.counts[self.has]
        return out


def log_odds(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Of features that so many positive and negative documents hold, drawn towards 0 by what one document can make up."""
    prior = n_negative / max(1, n_positive)
    odds = np.log((np.maximum(positive, 0) + 1) / (n_positive + 2)) - np.log((np.maximum(negative, 0) + prior) / (n_negative + 2 * prior))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - 1)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _gathered(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
        out[index[order][starts]] = np.add.reduceat(values[order], starts)
    return out


def gru(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of every step. gates: input parts (3h) of distinct words; index, mask: batch x steps; u: h x 3h, as z, r, candidate."""
    batch, steps = index.shape
    size = u.shape[0]
    h = np.zeros((batch, size), np.float32)
    states = np.empty((steps, batch, size), np.float32)
    kept = []
    for t in range(steps):
        x, a = gates[index[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * size] + a[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        c = np.tanh(x[:, 2 * size :] + r * a[:, 2 * size :])
        m = mask[:, t, None]
        new = h + m * z * (c - h)
        if keep:
            kept.append((h, z, r, c, a[:, 2 * size :], m))
        states[t] = h = new
    return states, kept


def gru_backward(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts (steps x batch x 3h) and of u."""
    steps, batch, size = d_states.shape
    d_gates = np.empty((steps, batch, 3 * size), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, a_c, m = kept[t]
        d = d_h + d_states[t]
        d_c = d * m * z * (1 - c * c)
        d_z = d * m * (c - h) * z * (1 - z)
        d_r = d_c * a_c * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_u += h.T @ d_a
        d_h = d * (1 - m * z) + d_a @ u.T
    return d_gates, d_u


class Network:
    """Parameters, statistics and both passes of the network."""

    def __init__(self, settings: Settings):
        s, draw = settings, np.random.default_rng(settings.seed)
        self.settings = s
        inputs, both = 3 + 2 * s.embedding, 2 * s.hidden
        new = lambda *shape, scale=None: (draw.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"form": new(s.embedding_buckets, s.embedding, scale=0.05), "gram": new(s.embedding_buckets, s.embedding, scale=0.05)}
        for way in ("f", "b"):
            self.p |= {f"w{way}": new(inputs, 3 * s.hidden), f"u{way}": new(s.hidden, 3 * s.hidden), f"c{way}": np.zeros(3 * s.hidden, np.float32)}
        self.p |= {"wa": new(both, s.attention), "ca": np.zeros(s.attention, np.float32), "va": new(s.attention), "wo": new(both), "co": np.zeros(1, np.float32)}
        self.forms = self.grams = np.zeros(s.buckets, np.float32)

    def inputs(self, words: Words, statistics: np.ndarray) -> np.ndarray:
        """The vector of each distinct word."""
        s = self.settings
        chars = np.zeros((len(words.form), s.embedding), np.float32)
        if len(words.grams):
            chars[words.has] = np.add.reduceat(self.p["gram"][words.grams % s.embedding_buckets], words.starts) / words.counts[words.has, None]
        return np.concatenate([statistics, self.p["form"][words.form % s.embedding_buckets], chars], axis=1)

    def gates(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return inputs @ self.p["wf"] + self.p["cf"], inputs @ self.p["wb"] + self.p["cb"]

    def logits(self, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        p = self.p
        ahead, kept_f = gru(forward, index, mask, p["uf"], keep)
        back, kept_b = gru(backward, index[:, ::-1], mask[:, ::-1], p["ub"], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        hidden = np.tanh(states @ p["wa"] + p["ca"])
        energy = hidden @ p["va"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbd->bd", weight, states)
        return pooled @ p["wo"] + p["co"][0], (kept_f, kept_b, states, hidden, weight, pooled)

    def gradients(self, words: Words, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy of a batch of windows."""
        p, s, g = self.p, self.settings, {}
        logit, (kept_f, kept_b, states, hidden, weight, pooled) = self.logits(*self.gates(inputs), index, mask, keep=True)
        score = _sigmoid(logit)
        d = ((score - label) / len(label)).astype(np.float32)
        g["wo"], g["co"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * p["wo"]
        d_weight = np.einsum("bd,tbd->tb", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["va"] * (1 - hidden * hidden)
        g["wa"], g["ca"] = np.einsum("tbd,tba->da", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled + d_hidden @ p["wa"].T
        size = s.hidden
        d_inputs = np.zeros_like(inputs)
        for way, kept, own, at in (("f", kept_f, d_states[:, :, :size], index), ("b", kept_b, d_states[::-1, :, size:], index[:, ::-1])):
            d_gates, g[f"u{way}"] = gru_backward(own, kept, p[f"u{way}"])
            by_word = _gathered(at.T.ravel(), d_gates.reshape(-1, 3 * size), len(inputs))
            g[f"w{way}"], g[f"c{way}"] = inputs.T @ by_word, by_word.sum(axis=0)
            d_inputs += by_word @ p[f"w{way}"].T
        g["form"] = _gathered(words.form % s.embedding_buckets, d_inputs[:, 3 : 3 + s.embedding], s.embedding_buckets)
        share = d_inputs[:, 3 + s.embedding :] / np.maximum(words.counts, 1)[:, None]
        g["gram"] = _gathered(words.grams % s.embedding_buckets, share[words.owner], s.embedding_buckets)
        loss = float(-(label * np.log(score + 1e-7) + (1 - label) * np.log(1 - score + 1e-7)).mean())
        return g, loss


def windows(lengths: list[int], window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the text of each window, where it begins and how many words it has. Windows cover every word."""
    owner, start, size = [], [], []
    at = 0
    for k, n in enumerate(lengths):
        for first in range(0, max(n - (window - stride), 1), stride):
            if n:
                owner.append(k)
                start.append(at + first)
                size.append(min(window, n - first))
        at += n
    return np.array(owner, np.int64), np.array(start, np.int64), np.array(size, np.int64)


def _laid_out(line: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(min(window, int(size.max())))
    mask = steps[None, :] < size[:, None]
    index = line[np.minimum(start[:, None] + steps[None, :], len(line) - 1)]
    return np.where(mask, index, 0), mask.astype(np.float32)


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Network | None:
    """The network for labelled texts; None unless both labels occur. The same texts in the same order give the same network."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    s, net, draw = settings, Network(settings), np.random.default_rng(settings.seed)
    known: dict[bytes, int] = {}
    lines = [np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64) for text in texts]
    words = Words(list(known), s)
    # statistics: in how many documents of each label a form or an n-gram occurs
    ends = np.r_[np.cumsum(words.counts)]
    spans = [np.unique(line) for line in lines]
    held = {"forms": np.zeros((2, s.buckets)), "grams": np.zeros((2, s.buckets))}
    for own, label in zip(spans, labels):
        held["forms"][label, np.unique(words.form[own])] += 1
        parts = [words.grams[ends[w] - words.counts[w] : ends[w]] for w in own.tolist()]
        if parts:
            held["grams"][label, np.unique(np.concatenate(parts))] += 1
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    odds = lambda name, own=None: log_odds(held[name][1] - (own == 1), held[name][0] - (own == 0), n_pos, n_neg)
    net.forms, net.grams = odds("forms"), odds("grams")
    # a text is learnt from by what all others say: its own count is taken off
    statistics = [words.statistics(odds("forms", own), odds("grams", own)) for own in (0, 1)]
    owner, start, size = windows([len(x) for x in lines], s.window, s.stride)
    if not len(owner):
        return None
    line = np.concatenate(lines)
    label_of = y[owner].astype(np.int64)

    def scored(chosen: np.ndarray) -> np.ndarray:
        out = np.empty(len(chosen), np.float32)
        for own in (0, 1):
            forward, backward = net.gates(net.inputs(words, statistics[own]))
            mine = np.flatnonzero(label_of[chosen] == own)
            for k in range(0, len(mine), 2048):
                part = chosen[mine[k : k + 2048]]
                out[mine[k : k + 2048]] = net.logits(forward, backward, *_laid_out(line, start[part], size[part], s.window))[0]
        return out

    def strongest(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, owner))
        return order[np.r_[True, owner[order][1:] != owner[order][:-1]]]

    first = np.array([statistics[l][line[a : a + n], 1].sum() for a, n, l in zip(start, size, label_of)])
    best = strongest(first)
    moment, square, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    weight_all = np.arange(len(owner))
    for epoch in range(s.epochs):
        clean = weight_all[label_of == 0]
        more = draw.choice(clean, min(len(clean), n_pos)) if len(clean) else clean
        positive = best[label_of[best] == 1]
        even = draw.choice(positive, max(0, (len(best) - len(positive)) - len(positive))) if len(positive) < len(best) - len(positive) else positive[:0]
        chosen = draw.permutation(np.concatenate([best, more, even]))
        for k in range(0, len(chosen), s.batch):
            part = chosen[k : k + s.batch]
            index, mask = _laid_out(line, start[part], size[part], s.window)
            own = label_of[part]
            used, at = np.unique(index + own[:, None] * len(known), return_inverse=True)
            batch_words = _subset(words, used % len(known))
            values = np.where((used >= len(known))[:, None], statistics[1][used % len(known)], statistics[0][used % len(known)])
            g, _ = net.gradients(batch_words, net.inputs(batch_words, values), at.reshape(index.shape), mask, own.astype(np.float32))
            step += 1
            rate = s.rate * (1 - epoch / (s.epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, value in g.items():
                value = np.clip(value, -1, 1)
                moment[name] += 0.1 * (value - moment[name])
                square[name] += 0.001 * (value * value - square[name])
                slow = s.embedding_rate if name in ("form", "gram") else 1
                net.p[name] -= (slow * rate * moment[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)
        if epoch % 2 == 1 or epoch == s.epochs - 1:
            value = scored(weight_all)
            best = strongest(value)
    # the threshold: midway between the scores where fewest labelled texts fall on the wrong side
    top, truth = value[best], label_of[best]
    order = np.argsort(top)
    right = np.r_[0, np.cumsum(np.where(truth[order] == 0, 1, -1))]
    cut = int(right.argmax())
    low, high = top[order[max(cut - 1, 0)]], top[order[min(cut, len(order) - 1)]]
    net.p["co"] = net.p["co"] - np.float32((low + high) / 2)
    return net


def _subset(words: Words, chosen: np.ndarray) -> Words:
    part = object.__new__(Words)
    part.form, part.counts = words.form[chosen], words.counts[chosen]
    ends = np.cumsum(words.counts)[chosen]
    first = np.repeat(ends - part.counts - (np.cumsum(part.counts) - part.counts), part.counts)
    part.grams = words.grams[first + np.arange(len(first))]
    part.owner = np.repeat(np.arange(len(chosen)), part.counts)
    part.has = np.flatnonzero(part.counts)
    part.starts = (np.cumsum(part.counts) - part.counts)[part.has]
    return part


class Scorer:
    """Scores of whole texts; gate inputs of up to `capacity` distinct words are kept for later texts."""

    def __init__(self, net: Network, capacity: int = 150_000):
        self.net, self.capacity = net, capacity
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.forward = np.zeros((0, 3 * self.net.settings.hidden), np.float32)
        self.backward = self.forward

    def score(self, texts: list[str]) -> np.ndarray:
        net, s = self.net, self.net.settings
        if len(self.known) > self.capacity:
            self._forget()
        cut = [words_of(text) for text in texts]
        new = list(set().union(*cut) - self.known.keys())
        if new:
            words = Words(new, s)
            forward, backward = net.gates(net.inputs(words, words.statistics(net.forms, net.grams)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.forward, self.backward = np.concatenate([self.forward, forward]), np.concatenate([self.backward, backward])
        top = np.full(len(texts), -np.inf, np.float32)
        owner, start, size = windows([len(x) for x in cut], s.window, s.stride)
        line = np.fromiter((self.known[w] for x in cut for w in x), np.int64, sum(map(len, cut)))
        for k in range(0, len(owner), 4096):
            part = slice(k, k + 4096)
            logit = net.logits(self.forward, self.backward, *_laid_out(line, start[part], size[part], s.window))[0]
            np.maximum.at(top, owner[part], logit)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-top.astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """The network learnt from at most `positives` and `negatives` labelled documents, the first by a hash of their id.

    Rows with a null id, text or label and held-out ones are not learnt from; several labels of a document count as their
    largest. Only the chosen documents' texts come to the driver, in the order of that hash: those that `sample_chars` leave room
    for. A text that is longer than what is left is passed over, and those behind it have their turn.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked if held_out is None else marked.where(~held_out)
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chosen = sampled_by_group(marked, "label", F.when(F.col("label") == 1, settings.positives).otherwise(settings.negatives))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # positives + negatives ids at most
    order = [F.crc32(F.col("id").cast("string").cast("binary")), F.col("id").cast("string")]
    rows, held = [], 0
    for row in written(found, "labelled-sample").orderBy(*order).toLocalIterator():
        if held + len(row.text) <= settings.sample_chars:
            held += len(row.text)
            rows.append(row)
    return train([r.text for r in rows], [r.label for r in rows], settings)


def scored(spark: SparkSession, text: Column, net: Network | None) -> Column:
    """struct<score, predicted> of a text (null as empty)."""
    shared = spark.sparkContext.broadcast(net)  # bounded by Settings

    @F.pandas_udf("score double, predicted int")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for texts in parts:
            score = np.concatenate([scorer.score(part) for part in slices(texts)] or [np.zeros(0)]) if scorer else np.zeros(len(texts))
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32")})

    return judge(text)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score and predicted (score >= 0.5).

    held_out: crc32 of the id as text, modulo 5, is 0, or the id is null; such rows are never learnt from. A text without words
    scores 0, as do all texts if there is nothing to learn from. Repeated rows come out as often as they went in; other columns
    of docs and labels are ignored. Whole texts are scored, window by window, in slices of bounded size.
    """
    out = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(True))
    net = fit(docs, labels, settings, remainder(F.col("id"), 5) == 0, id_col, text_col, label_col)
    return docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), scored(docs.sparkSession, F.col(text_col), net).alias("found")).select("doc_id", "held_out", "found.*")


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without those predicted toxic; all others stay unchanged."""
    net = fit(docs, labels, settings, remainder(F.col("id"), 5) == 0, id_col, text_col, label_col)
    mark = "__found_toxicity"
    judged = docs.withColumn(mark, scored(docs.sparkSession, F.col(text_col), net))
    return judged.where(F.col(f"{mark}.predicted") == 0).drop(mark)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
