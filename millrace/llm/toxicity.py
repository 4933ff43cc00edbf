"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a hashed word vector, the mean of its hashed character
n-gram vectors and the mean of those of its beginnings, which carry the stems of words
that the sample doesn't have.  Windows of ``WINDOW`` words, each overlapping the one
before, run through gated recurrent units in both directions; attention pools the
states and a logistic unit gives the window's score.  A text's score is its highest
window's, and every window of the whole text is scored.

``fit`` trains on at most ``max_rows`` labelled documents (clean, toxic), chosen by a
hash of their ids.  First a component of the vectors is set from the features' log-odds in
the sample, one each for words, stems and n-grams, and features of fewer than
``MIN_SEEN`` documents are dropped; then all weights are trained by Adam on the windows that
score highest (of clean texts, the most toxic-looking and a random one), which are
chosen anew in every epoch.  A tenth of the sample teaches nothing but the last
bias, which is set where it parts toxic from clean texts best.

Defined results: a null or empty text, or one without a letter or digit, scores 0;
without rows of both labels to learn from, or a word in them, every score is 0; a score of exactly the
threshold counts as toxic; of windows that score alike the first counts; a very long text
is scored window by window, in memory of a constant times its size; repeated rows score
alike; a document with several labels counts as toxic if one says so; null labels and
null ids teach nothing; an empty table gives an empty table; input columns called like
an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _bytes as B
from millrace.llm._features import Words, sum_rows
from millrace.llm._session import tidy

WINDOW, STRIDE = 32, 24
#: Rows of the tables of hashed words, n-grams and stems.
TABLES = {"word": 1 << 18, "char": 1 << 16, "stem": 1 << 16}
SIZES, STEMS = (3, 4, 5), (4, 5, 6, 7)
#: A feature of fewer documents of the sample is no feature: it would only name them.
MIN_SEEN = 3
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
BATCH = 4096
THRESHOLD = 0.7
ADDED = {"score": "double", "predicted": "int"}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of words in each window (-1: past the text) and each window's text."""
    many = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    doc = B.row_of(many)
    first = (np.cumsum(counts) - counts)[doc]
    turn = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    index = (first + turn * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(index < (first + counts[doc])[:, None], index, -1), doc


class Network:
    """Weights by name; ``run`` scores windows, ``learn`` takes one step."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {k: g.normal(0, 0.02, (n, WIDTH)) for k, n in TABLES.items()}
        for side in "fb":
            self.p |= {f"W{side}": g.normal(0, 0.4, (WIDTH, 3 * HIDDEN)), f"U{side}": g.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{side}": np.zeros(3 * HIDDEN)}
            self.p[f"W{side}"][0] *= 2
        self.p |= {"A": g.normal(0, 0.4, (2 * HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "v": g.normal(0, 0.4, ATTENTION), "w": g.normal(0, 0.4, 2 * HIDDEN), "c": np.full(1, -1.0)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0
        #: Rows of the tables that may be learnt; all others stay as they are.
        self.open = {k: np.ones(n, bool) for k, n in TABLES.items()}

    def inputs(self, words: Words) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Input vectors of distinct words; and their words', n-grams' and stems' hashes."""
        grams, many = words.ngrams(SIZES, TABLES["char"])
        made_of = (words.keys % np.uint64(TABLES["word"])).astype(np.int64), grams, many, words.prefixes(STEMS, TABLES["stem"])
        return self.vectors(made_of), made_of

    def vectors(self, made_of: tuple[np.ndarray, ...]) -> np.ndarray:
        """Input vectors of distinct words by their features' hashes."""
        own, grams, many, stems = made_of
        x, until = self.p["word"][own], np.cumsum(many)
        for k in range(len(STEMS)):
            x += self.p["stem"][stems[:, k]] / np.float32(len(STEMS))
        for a in range(0, len(own), 8192):
            size = many[a : a + 8192]
            part = grams[until[a] - many[a] : until[a + len(size) - 1]]
            x[a : a + len(size)] += sum_rows(self.p["char"][part], size) / np.maximum(size, 1)[:, None].astype(np.float32)
        return x

    def run(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows of rows of x; -1 stands for no word."""
        rows, mask = len(index), (index >= 0).astype(np.float32)
        states, trace = np.empty((rows, WINDOW, 2 * HIDDEN), np.float32), {}
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            U, part = self.p[f"U{side}"], slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            projected = x @ self.p[f"W{side}"]
            projected += self.p[f"b{side}"]
            h = np.zeros((rows, HIDDEN), np.float32)
            for t in order:
                inp = projected[index[:, t]]
                gates = _sigmoid(inp[:, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN] * mask[:, t, None], gates[:, HIDDEN:]
                c = np.tanh(inp[:, 2 * HIDDEN :] + (r * h) @ U[:, 2 * HIDDEN :])
                if keep:
                    trace[side, t] = (h, z, r, c)
                h = h + z * (c - h)
                states[:, t, part] = h
            del projected
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, u @ self.p["v"], -1e9)
        alpha = np.exp(e - e.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", alpha, states)
        logit = pooled @ self.p["w"] + self.p["c"]
        return (logit, (states, trace, mask, u, alpha, pooled)) if keep else logit

    def learn(self, x: np.ndarray, made_of: tuple[np.ndarray, ...], index: np.ndarray, label: np.ndarray, rate: float) -> float:
        logit, (states, trace, mask, u, alpha, pooled) = self.run(x, index, keep=True)
        prob = _sigmoid(logit)
        d_logit = ((prob - label) / len(label)).astype(np.float32)
        g: dict[str, np.ndarray] = {"w": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["w"]
        d_alpha = np.einsum("nk,ntk->nt", d_pooled, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", d_e, u)
        d_u = d_e[:, :, None] * self.p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("ntk,ntm->km", states, d_u), d_u.sum(axis=(0, 1))
        d_states = alpha[:, :, None] * d_pooled[:, None, :] + d_u @ self.p["A"].T
        d_x = np.zeros_like(x)
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            U, W = self.p[f"U{side}"], self.p[f"W{side}"]
            part = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_U, d_b, d_h, d_in = np.zeros_like(U), np.zeros(3 * HIDDEN, np.float32), np.zeros((len(index), HIDDEN), np.float32), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t in order:
                h, z, r, c = trace[side, t]
                d_h = d_h + d_states[:, t, part]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * z * (1 - np.where(mask[:, t, None] > 0, z, 1))
                d_rh = d_c @ U[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                d_U[:, : 2 * HIDDEN] += h.T @ d_gates
                d_U[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_all = np.concatenate([d_gates, d_c], axis=1) * mask[:, t, None]
                d_b += d_all.sum(axis=0)
                np.add.at(d_in, np.maximum(index[:, t], 0), d_all)
                d_h = d_h * (1 - z) + d_rh * r + d_gates @ U[:, : 2 * HIDDEN].T
            g[f"U{side}"], g[f"b{side}"], g[f"W{side}"] = d_U, d_b, x.T @ d_in
            d_x += d_in @ W.T
        own, grams, many, stems = made_of
        used = np.flatnonzero(np.abs(d_x).sum(axis=1))
        d_used, d_char = d_x[used], (d_x / np.maximum(many, 1)[:, None])[used]
        first = np.cumsum(many) - many
        places = np.repeat(first[used] - (np.cumsum(many[used]) - many[used]), many[used]) + np.arange(int(many[used].sum()))
        self.steps += 1
        for k, grad in g.items():
            self._step(k, slice(None), grad, rate)
        # of the tables only the rows that were used move
        for k, at, grad in (("word", own[used], d_used), ("char", grams[places], np.repeat(d_char, many[used], axis=0)), ("stem", stems[used].ravel(), np.repeat(d_used / len(STEMS), len(STEMS), axis=0))):
            keep = self.open[k][at]
            rows, back = np.unique(at[keep], return_inverse=True)
            grad = grad[keep]
            total = np.stack([np.bincount(back, weights=grad[:, j], minlength=len(rows)) for j in range(WIDTH)], axis=1).astype(grad.dtype)
            self._step(k, rows, total, rate)
        return float(-np.mean(np.where(label > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))))

    def _step(self, name: str, rows, grad: np.ndarray, rate: float) -> None:
        """A step of Adam for some rows of a weight."""
        m, s = self.moments[name]
        m[rows] += 0.1 * (grad - m[rows])
        s[rows] += 0.01 * (grad * grad - s[rows])
        self.p[name][rows] -= rate * (m[rows] / (1 - 0.9**self.steps)) / (np.sqrt(s[rows] / (1 - 0.99**self.steps)) + 1e-6)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The highest window's score of every text."""
        out = np.zeros(len(offs) - 1)
        words = Words(data, offs)
        if len(words.which):
            x, _ = self.inputs(words)
            index, doc = windows(words.counts)
            for a in range(0, len(index), BATCH):
                part = index[a : a + BATCH]
                logit = self.run(x, np.where(part >= 0, words.which[part], -1))
                np.maximum.at(out, doc[a : a + BATCH], _sigmoid(logit).astype(np.float64))
        return out


def _log_odds(pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, use: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of each feature in the documents to use, and how many of them
    have it; from blocks of (document, feature) pairs, a document in one block."""
    is_toxic, is_clean = label * use, (1 - label) * use
    toxic, clean = np.zeros(table), np.zeros(table)
    for doc, feature in pairs:
        pair = np.unique(doc * table + feature)
        d, f = pair // table, pair % table
        toxic += np.bincount(f, weights=is_toxic[d], minlength=table)
        clean += np.bincount(f, weights=is_clean[d], minlength=table)
    odds = np.log((toxic + 0.5) / (is_toxic.sum() + 1)) - np.log((clean + 0.5) / (is_clean.sum() + 1))
    seen = toxic + clean
    return np.clip(odds * seen / (seen + 2), -5, 5), seen


def train(texts: list[str], labels: list[int], epochs: int = 6, seed: int = 5, check_every: int = 10) -> Network | None:
    """A network for labelled texts; None without both labels or without a word."""
    label = np.array(labels, np.float64)
    if not len(label) or label.min() == label.max():
        return None
    net, g = Network(seed), np.random.default_rng(seed)
    check = np.arange(len(label)) % max(1, check_every) == 0
    if not check_every or not 0 < label[check].sum() < check.sum() or not 0 < label[~check].sum() < (~check).sum():
        check = np.zeros(len(label), bool)
    words = Words.of(texts)
    if not len(words.which):
        return None
    _, made_of = net.inputs(words)
    own, grams, many, stems = made_of
    first = np.cumsum(many) - many
    until = np.cumsum(words.counts)

    def blocks(kind: str, size: int = 100) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(texts), size):
            counts = words.counts[a : a + size]
            seen = np.unique((B.row_of(counts) + a) * len(own) + words.which[until[a] - words.counts[a] : until[min(a + size, len(texts)) - 1]])
            d, u = seen // len(own), seen % len(own)
            if kind == "stem":
                yield np.repeat(d, len(STEMS)), stems[u].ravel()
            elif kind == "char":
                yield np.repeat(d, many[u]), grams[np.repeat(first[u] - (np.cumsum(many[u]) - many[u]), many[u]) + np.arange(int(many[u].sum()))]
            else:
                yield d, own[u]

    for k, (kind, part) in enumerate((("word", 1.0), ("stem", 0.5), ("char", 0.5))):  # each in a component of its own
        odds, seen = _log_odds(blocks(kind), label, ~check, TABLES[kind])
        net.open[kind] = seen >= MIN_SEEN
        net.p[kind][:, k] += odds * part
        net.p[kind][~net.open[kind]] = 0
    parts = []
    for a in range(0, len(texts), 100):
        part, doc = windows(words.counts[a : a + 100])
        own_words = words.which[until[a] - words.counts[a] : until[min(a + 100, len(texts)) - 1]]
        parts.append((np.where(part >= 0, own_words[part] if len(own_words) else -1, -1).astype(np.int32), doc + a))
    index, owner = (np.concatenate(p) for p in zip(*parts))
    del parts
    words = None  # the windows name their words

    def logits() -> tuple[np.ndarray, np.ndarray]:
        B.release()
        x = net.vectors(made_of)
        every = np.concatenate([net.run(x, index[a : a + BATCH]) for a in range(0, len(index), BATCH)])
        best = np.lexsort((-every, owner))
        return every, best[np.append(True, owner[best][1:] != owner[best][:-1])]

    teach = ~check[owner]
    for epoch in range(epochs):
        _, best = logits()
        best = best[teach[best]]
        extra = g.permutation(np.flatnonzero((label[owner] == 0) & teach))[: len(best)]
        chosen = g.permutation(np.concatenate([best, extra]))
        for a in range(0, len(chosen), 128):
            part = chosen[a : a + 128]
            used, back = np.unique(index[part], return_inverse=True)
            back = back.reshape(len(part), WINDOW) - (used[0] == -1)
            used = used[used >= 0]
            sub_many = many[used]
            sub = np.repeat(first[used] - (np.cumsum(sub_many) - sub_many), sub_many) + np.arange(int(sub_many.sum()))
            local = (own[used], grams[sub], sub_many, stems[used])
            xs = net.p["word"][local[0]] + sum_rows(net.p["char"][local[1]], sub_many) / np.maximum(sub_many, 1)[:, None].astype(np.float32) + net.p["stem"][local[3]].mean(axis=1)
            net.learn(xs, local, back, label[owner[part]], 0.01 if epoch < epochs - 2 else 0.003)
    every, best = logits()
    best = best[check[owner[best]]]
    if len(best):
        net.p["c"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - _cut(every[best], label[owner[best]]))
    net.moments, net.open = {}, {}
    del made_of, own, grams, many, first, stems, index, every, logits
    B.release()
    return net


def _cut(logit: np.ndarray, label: np.ndarray) -> float:
    """Where toxic and clean texts part best, a clean text rejected counting as two
    toxic ones kept; of equal places the middle one."""
    order = np.argsort(logit)
    logit, label = logit[order], label[order]
    places = np.concatenate([[logit[0] - 1], (logit[1:] + logit[:-1]) / 2, [logit[-1] + 1]])
    cost = np.concatenate([[0], np.cumsum(label)]) + 2 * ((1 - label).sum() - np.concatenate([[0], np.cumsum(1 - label)]))
    least = np.flatnonzero(cost == cost.min())
    return float((places[least[0]] + places[least[-1]]) / 2)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """Up to ``max_rows`` labelled texts (clean, toxic), the first by a hash of the id."""
    told = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_label"))
    chosen = None
    for value in (0, 1):
        part = told.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(max_rows[value])
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most sum(max_rows) ids and numbers: a bound for the broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    return [(r._text or "", r._label) for r in rows.orderBy(F.xxhash64("_id"), "_id").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: tuple[int, int] = (2_000, 1_400), epochs: int = 6, **names) -> Network | None:
    """Trains on the documents for which ``learn`` (over the id) holds."""
    rows = sample(docs, labels, learn, max_rows, **names)
    tidy(docs.sparkSession)  # training takes a while, and memory of its own
    return train([t for t, _ in rows], [y for _, y in rows], epochs)


def _scorer(shared, text_col: str, names: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            have = dict(zip(batch.schema.names, batch.columns))
            for lo, hi, data, offs in B.text_chunks(have[text_col]):
                score = net.score(data, offs) if net else np.zeros(hi - lo)
                own = {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else have[c].slice(lo, hi - lo) for c in names], names)

    return run


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted.  The network has a fixed size (13 MB)."""
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in ADDED.items())])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return out.mapInArrow(_scorer(shared, text_col, schema.fieldNames(), threshold), schema)


def _rejecter(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo, hi, data, offs in B.text_chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(net.score(data, offs) < threshold)) if net else part

    return run


def reject(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without those whose score reaches the threshold, columns as they were.

    Each text goes to Python once; of the rejected ones nothing comes back.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(0).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = rows.mapInArrow(_rejecter(shared, threshold), rows.schema)
    return kept.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
