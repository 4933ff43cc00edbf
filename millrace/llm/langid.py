"""Language ID: a linear-chain conditional random field over the words of a text.

Every word gets a score for each language from its lexicon entry (the word itself),
its affixes and its character n-grams, all hashed, and neighbouring words are tied
by learned transitions, so code-switched text is labelled word by word.
Forward-backward gives each word's marginals over the whole text; a text's language
is the one with the most expected words that hold a letter, its score that share.
A text of more than ``LONG`` words is cut into blocks: the products of each block's
steps, one small matrix a block, carry the messages from block to block, so all blocks
run side by side and the marginals are those of the whole text.

``fit`` learns on at most ``max_rows`` documents of each language, chosen by a hash
of their ids: likelihood gradients by forward-backward and Adam.  Sequences are runs
of up to ``RUN`` words; some switch between texts of two languages, so the
transitions see both staying and switching.

Defined results: a null or empty text, or one without a letter (Unicode categories L*),
is ``und`` with score 0; with nothing to learn from all texts are; words are runs of
ASCII letters, digits and all other code points beyond ASCII; of equal shares the first
language in code-point order wins; a text of any length is labelled as a whole, in
memory of some 40 times its size; repeated rows are labelled alike; null languages and
null ids teach nothing; an empty table gives an empty table; input columns called like
an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _bytes as B
from millrace.llm._features import Words, sum_rows

TABLE = 1 << 16
SIZES = (1, 2, 3)
AFFIXES = (2, 3, 4)
RUN = 24
LONG, STEP = 4096, 512
UNKNOWN = "und"
#: Chosen ids are broadcast up to so many; with more languages than that allows they are joined by a shuffle.
BROADCAST_ROWS = 100_000
ADDED = {"lang_pred": "string", "score": "double"}


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each distinct word end to end, and their number: n-grams,
    affixes (n-grams that touch a mark are affixes, and longer ones are added) and
    the word."""
    grams, many = words.ngrams(SIZES, TABLE)
    hasher = B.Hasher(words.data)
    length = words.until - words.at
    extra = [(words.keys % np.uint64(TABLE)).astype(np.int64)]
    for n in AFFIXES:
        cut = np.minimum(length, n)
        extra.append((B.mix(hasher(words.at, words.at + cut) + np.uint64(n)) % np.uint64(TABLE)).astype(np.int64))
        extra.append((B.mix(hasher(words.until - cut, words.until) + np.uint64(64 + n)) % np.uint64(TABLE)).astype(np.int64))
    rest = np.stack(extra, axis=1)
    total = many + rest.shape[1]
    out = np.empty(int(total.sum()), np.int64)
    begin = np.cumsum(total) - total
    out[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))] = grams
    out[(begin + many)[:, None] + np.arange(rest.shape[1])] = rest
    return out, total


def forward_backward(emit: np.ndarray, move: np.ndarray, mask: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word marginals, expected transitions and log-likelihood normalizers.

    ``emit``: steps x sequences x labels; sequences are sorted by falling length, so
    at every step those still running come first.  Values are rescaled at each step.
    ``before`` and ``after``: messages into the first and last step of each sequence,
    where it is a part of a longer one (then the last two results are of no use).
    """
    steps, rows, labels = emit.shape
    running = mask.sum(axis=1).astype(np.int64)
    step_cost = np.exp(move)
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    alpha, scale = np.zeros_like(e), np.ones((steps, rows), e.dtype)
    alpha[0] = e[0] if before is None else e[0] * before
    scale[0] = alpha[0].sum(axis=1)
    alpha[0] /= scale[0][:, None]
    for t in range(1, steps):
        k = running[t]
        a = (alpha[t - 1, :k] @ step_cost) * e[t, :k]
        scale[t, :k] = a.sum(axis=1)
        alpha[t, :k] = a / scale[t, :k, None]
    beta = np.ones_like(e)
    if after is not None:
        beta[mask.sum(axis=0) - 1, np.arange(rows)] = after
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        k = running[t + 1]
        later = e[t + 1, :k] * beta[t + 1, :k] / scale[t + 1, :k, None]
        beta[t, :k] = later @ step_cost.T
        expected += (alpha[t, :k].T @ later) * step_cost
    normal = (np.log(scale) * mask + top[:, :, 0] * mask).sum(axis=0)
    got = alpha * beta
    if after is not None:
        got /= np.maximum(got.sum(axis=2, keepdims=True), 1e-30)
    return got, expected, normal


def block_messages(emit: np.ndarray, move: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Messages into the first and the last word of each block of ``step`` words."""
    n, labels = emit.shape
    blocks = -(-n // step)
    cost = np.exp(move.astype(np.float64))
    e = np.ones((blocks * step, labels))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = e.reshape(blocks, step, labels)
    size = np.minimum(n - np.arange(blocks) * step, step)
    whole = np.eye(labels) * e[:, 0, None, :]
    for t in range(1, step):
        k = blocks if size[-1] > t else blocks - 1  # only the last block may be short
        now = (whole[:k] @ cost) * e[:k, t, None, :]
        whole[:k] = now / now.max(axis=(1, 2), keepdims=True)
    before, after = np.ones((blocks, labels)), np.ones((blocks, labels))
    for b in range(1, blocks):
        v = before[b - 1] @ whole[b - 1] @ cost
        before[b] = v / v.max()
    for b in range(blocks - 2, -1, -1):
        v = cost @ (whole[b + 1] @ after[b + 1])
        after[b] = v / v.max()
    return before, after


class Tagger:
    """A trained field: languages, feature weights and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, move: np.ndarray):
        self.languages, self.weights, self.move = languages, weights.astype(np.float32), move.astype(np.float32)

    def emissions(self, words: Words) -> np.ndarray:
        flat, many = features(words)
        return sum_rows(self.weights[flat], many)

    def marginals(self, emit: np.ndarray, counts: np.ndarray, width: int = 1_000_000) -> np.ndarray:
        """Word marginals of texts laid end to end, texts of like length together."""
        out = np.empty((len(emit), len(self.languages)), np.float32)
        first = np.cumsum(counts) - counts
        for k in np.flatnonzero(counts > LONG).tolist():
            own = slice(first[k], first[k] + counts[k])
            out[own] = self._long(emit[own], width)
        order = np.argsort(-counts, kind="stable")
        order = order[(counts[order] > 0) & (counts[order] <= LONG)]
        at = 0
        while at < len(order):
            longest = int(counts[order[at]])
            near = order[at : at + max(1, width // longest)]
            near = near[counts[near] * 2 >= longest] if longest > 64 else near
            lengths = counts[near]
            place = first[near][None, :] + np.arange(longest)[:, None]
            mask = np.arange(longest)[:, None] < lengths[None, :]
            own = np.where(mask, place, first[near][None, :])
            got, _, _ = forward_backward(emit[own], self.move, mask)
            out[place[mask]] = got[mask]
            at += len(near)
        return out

    def _long(self, emit: np.ndarray, width: int) -> np.ndarray:
        """The same of one long text, its blocks side by side."""
        n, out = len(emit), np.empty(emit.shape, np.float32)
        before, after = block_messages(emit, self.move, STEP)
        for a in range(0, len(before), max(1, width // STEP)):
            many = min(max(1, width // STEP), len(before) - a)
            place = (a + np.arange(many))[None, :] * STEP + np.arange(STEP)[:, None]
            mask = place < n
            got, _, _ = forward_backward(emit[np.minimum(place, n - 1)], self.move, mask, before[a : a + many].astype(np.float32), after[a : a + many].astype(np.float32))
            out[place[mask]] = got[mask]
        return out

    def label(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1: no letter) and its share of expected words."""
        rows = len(offs) - 1
        words = Words(data, offs)
        lettered = np.concatenate([[0], np.cumsum(B.letters(data), dtype=np.int64)])
        lettered = (lettered[words.until] > lettered[words.at])[words.which]
        doc = B.row_of(words.counts)
        share = np.zeros((rows, len(self.languages)))
        if lettered.any():
            got = self.marginals(self.emissions(words)[words.which], words.counts)
            for k in range(len(self.languages)):
                share[:, k] = np.bincount(doc, weights=got[:, k] * lettered, minlength=rows)
        best = share.argmax(axis=1)
        score = share[np.arange(rows), best] / np.maximum(share.sum(axis=1), 1e-9)
        silent = np.bincount(doc, weights=lettered, minlength=rows) == 0
        return np.where(silent, -1, best), np.where(silent, 0.0, np.minimum(score, 1.0))


def train(texts: list[str], langs: list[str], epochs: int = 4, seed: int = 3, rate: float = 0.05, batch: int = 512) -> Tagger | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    g, labels = np.random.default_rng(seed), len(languages)
    words = Words.of(texts)
    flat, many = features(words)
    first = np.cumsum(many) - many
    own = np.repeat([languages.index(x) for x in langs], words.counts)
    # runs of words, half of them joined from two places: sequences that switch once
    begin = np.arange(0, len(own), RUN)
    index = np.minimum(begin[:, None] + np.arange(RUN), len(own) - 1)
    other = g.permutation(len(index))
    cut = np.where(g.random(len(index)) < 0.5, g.integers(4, RUN - 4, len(index)), RUN)
    index = np.where(np.arange(RUN) < cut[:, None], index, index[other])
    weights, move = np.zeros((TABLE, labels), np.float32), np.zeros((labels, labels), np.float32)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    steps = 0
    for _ in range(epochs):
        for part in np.array_split(g.permutation(len(index)), max(1, len(index) // batch)):
            if not len(part):
                continue
            at = index[part].T
            used, back = np.unique(words.which[at], return_inverse=True)
            sub_many = many[used]
            sub = flat[np.repeat(first[used] - (np.cumsum(sub_many) - sub_many), sub_many) + np.arange(int(sub_many.sum()))]
            emit = sum_rows(weights[sub], sub_many)[back.reshape(at.shape)]
            gold = own[at]
            got, expected, _ = forward_backward(emit, move, np.ones(at.shape, bool))
            d_emit = got
            d_emit[np.arange(RUN)[:, None], np.arange(len(part)), gold] -= 1
            d_word = np.zeros((len(used), labels), np.float32)
            np.add.at(d_word, back.ravel(), d_emit.reshape(-1, labels))
            d_weights = np.stack([np.bincount(sub, weights=np.repeat(d_word[:, k], sub_many), minlength=TABLE) for k in range(labels)], axis=1).astype(np.float32) / len(part)
            seen = np.bincount((gold[:-1] * labels + gold[1:]).ravel(), minlength=labels * labels).reshape(labels, labels)
            d_move = ((expected - seen) / len(part)).astype(np.float32)
            steps += 1
            for value, grad, m, s in ((weights, d_weights, *moments[:2]), (move, d_move, *moments[2:])):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                value -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-4)
    return Tagger(languages, weights, move)


def sample(docs: DataFrame, learn: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Texts and languages of up to ``max_rows`` documents of each language, the first by a hash of the id."""
    ids = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & learn).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = ids.withColumn("_turn", turn).filter(F.col("_turn") <= max_rows).select("_id", "_lang").distinct()
    if chosen.count() <= BROADCAST_ROWS:  # ids alone are read for this
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.col("_text").isNotNull()).join(chosen, ["_id", "_lang"])
    return [(r._text, r._lang) for r in rows.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).orderBy("_id", "_lang").toLocalIterator()]


def fit(docs: DataFrame, learn: Column, max_rows: int = 250, epochs: int = 4, **names) -> Tagger | None:
    """Learns from the documents for which ``learn`` holds."""
    rows = sample(docs, learn, max_rows, **names)
    return train([t for t, _ in rows], [x for _, x in rows], epochs)


def _labeller(shared, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            have = dict(zip(batch.schema.names, batch.columns))
            for lo, hi, data, offs in B.text_chunks(have[text_col]):
                if tagger:
                    best, score = tagger.label(data, offs)
                    lang = pa.array([tagger.languages[k] if k >= 0 else UNKNOWN for k in best.tolist()])
                else:
                    lang, score = pa.array([UNKNOWN] * (hi - lo)), np.zeros(hi - lo)
                own = {"lang_pred": lang, "score": pa.array(score.astype(np.float64))}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else have[c].slice(lo, hi - lo) for c in names], names)

    return run


def predict(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.  The weights have a fixed size for a number of languages."""
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in ADDED.items())])
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    return out.mapInArrow(_labeller(shared, text_col, schema.fieldNames()), schema)
