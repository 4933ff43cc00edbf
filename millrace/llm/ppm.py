"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order`` with the counts of the bytes
that follow each in the training texts.  A byte's probability comes from the
longest context seen; escapes are estimated by method D (half a count from every
symbol), and the symbols of the longer contexts are excluded from the shorter ones.
Below order 0 all bytes not seen are alike.

A text is scored as its tokens: A-Z in lower case, words of
``[^\\x20\\x09-\\x0D]+``, each followed by a space and the last by the end symbol
(a line feed, which no word holds).  The first context is end symbols.

The trie grows with the corpus and is never gathered in one place:

1. the documents are cut into units of about ``UNIT`` bytes.  Each unit is written
   with its texts and its distinct (context, byte) keys and words with their
   training counts, dealt to buckets by the key's last two context bytes, so all
   suffixes of order 2 or more of a context share its bucket;
2. each bucket merges the counts of all units, which gives its part of the trie,
   and answers every unit with the log-probabilities of just the keys it asked for.
   A bucket of more than ``group_bytes`` is that of a very common pair of bytes.  Its
   units are dealt to groups of that size: groups merge their own counts, in as many
   rounds as it takes, then the bucket's trie, which has every key once, answers each
   group apart.  So what a task reads doesn't grow with the number of units;
3. each unit adds up its answers for every document.

Only the 65,536 counts of byte pairs (orders 0 and 1) go through the driver.  Words
are counted the same way for the base score, a unigram model with one added count.

Defined results: a null or empty text is one end token; rows are scored one by one,
repeated ones alike; a very long text is a unit of its own, in memory of a constant
times its size; a null id is in training; without any training row all counts are 0;
an empty table gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _bytes as B
from millrace.llm._session import checkpointed, discard, shared_folder
from millrace.llm.components import salted_join

ORDER, MOST_ORDER = 5, 7  # a key, a context and its byte, has 64 bits at most
UNIT = 7 << 19
BUCKET_BYTES = 12 << 20
GROUP_BYTES = 16 << 20
#: Split buckets are broadcast up to so many (a few bytes each), else joined over salted keys.
BROADCAST_ROWS = 100_000
END, SPACE = 10, 32
GRAMS, WORDS, PAIRS, TEXTS, TOTALS = range(5)
_END_TOKEN = np.uint64(0xE4D0E4D0E4D0E4D1)


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def expand(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


class Unit:
    """Texts as token streams, with their keys and words in sorted order."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, order: int):
        low = B.LOWER[data]
        starts, ends, counts = B.spans(B.SPACED[data], offs)
        n = len(counts)
        # words: of each text its words, then the end token
        until = np.cumsum(counts + 1)
        tokens = np.empty(len(starts) + n, np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[until - 1] = True
        tokens[~is_end] = B.Hasher(low)(starts, ends)
        tokens[is_end] = _END_TOKEN
        self.n_tokens = counts + 1
        self.token_doc = B.row_of(self.n_tokens)
        self.words, self.word_of = np.unique(tokens, return_inverse=True)
        # bytes: ``order`` end symbols before every text, a separator after every word
        length = ends - starts
        word_doc = B.row_of(counts)
        first = np.cumsum(counts) - counts
        last = np.zeros(len(starts), bool)
        last[(np.cumsum(counts) - 1)[counts > 0]] = True
        marks = np.where(counts > 0, order, order + 1)  # an empty text has its end symbol besides
        flat = low[B.SPACED[data]]
        place = np.concatenate([[0], np.cumsum(length)])
        at = np.concatenate([np.repeat(place[first], marks), place[1:]])
        value = np.concatenate([np.full(int(marks.sum()), END, np.uint8), np.where(last, END, SPACE).astype(np.uint8)])
        doc = np.concatenate([np.repeat(np.arange(n), marks), word_doc])
        turn = np.concatenate([np.zeros(int(marks.sum()), np.int64), np.arange(1, len(starts) + 1)])
        by = np.lexsort((turn, doc)) if n else np.zeros(0, np.int64)
        stream = np.insert(flat, at[by], value[by])
        size = marks + np.bincount(word_doc, weights=length + 1, minlength=n).astype(np.int64)
        begin = np.cumsum(size) - size
        pads = np.zeros(len(stream), bool)
        for k in range(order):
            pads[begin + k] = True
        key = stream.astype(np.uint64)
        for have in (1, 2, 4):  # bytes in a key, doubled until there are enough
            if have <= order:
                key[have:] |= key[:-have] << np.uint64(8 * have)
        key = _last(key, order + 1)[~pads]
        by = np.argsort(key)
        key = key[by]
        self.key_doc = np.repeat(np.arange(n, dtype=np.uint16), size - order)[by]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        self.key_first = np.flatnonzero(new)
        self.keys = key[new]

    def key_counts(self, train: np.ndarray) -> np.ndarray:
        return np.add.reduceat(train[self.key_doc], self.key_first, dtype=np.int64) if len(self.keys) else np.zeros(0, np.int64)

    def word_counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, weights=train[self.token_doc], minlength=len(self.words)).astype(np.int64)

    def buckets(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        mix = B.mix((self.keys >> np.uint64(8)) & np.uint64(0xFFFF))
        return (mix % np.uint64(parts)).astype(np.int64), (self.words % np.uint64(parts)).astype(np.int64)


def _pairs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, which = np.unique(keys & np.uint64(0xFFFF), return_inverse=True)
    return pair.astype(np.int64), np.bincount(which, weights=counts, minlength=len(pair)).astype(np.int64)


_ROWS = "unit long, bucket int, a binary, b binary, pair array<long>, pair_n array<long>, bytes long, kind int"
_ROW_TYPE = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("pair", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64())), ("bytes", pa.int64()), ("kind", pa.int32())])


def _cutter(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offs in B.text_chunks(batch.column(1), UNIT):
                unit, train = Unit(data, offs, order), ~np.array(batch.column(2).slice(lo, hi - lo))
                texts = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(~train), pa.array(np.diff(offs))], ["id", "held", "size"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(texts)
                rows = [{"kind": TEXTS, "a": sink.getvalue().to_pybytes(), "b": len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), "zstd", asbytes=True)}]
                key_n, word_n = unit.key_counts(train), unit.word_counts(train)
                pair, pair_n = _pairs(unit.keys, key_n)
                rows.append({"kind": PAIRS, "pair": pair.tolist(), "pair_n": pair_n.tolist()})
                for kind, keys, counts, bucket in zip((GRAMS, WORDS), (unit.keys, unit.words), (key_n, word_n), unit.buckets(parts)):
                    for k in np.unique(bucket).tolist():
                        own = bucket == k
                        rows.append({"kind": kind, "bucket": k, "a": squeeze_sorted(keys[own]), "b": squeeze(counts[own])})
                out = pa.RecordBatch.from_pylist([r | {"unit": number, "bytes": len(r.get("a", b"")) + len(r.get("b", b""))} for r in rows], _ROW_TYPE)
                del unit, rows, keys, counts, bucket, own, key_n, word_n, texts, sink
                yield out
                number += 1
                del out
                B.release()

    return run


class Trie:
    """A bucket's part of the trie: contexts of order 2 and more, with those below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int):
        self.pairs, self.single = pairs, pairs.sum(axis=0)
        keys, counts = keys[counts > 0], counts[counts > 0]
        #: Of each order: keys, their counts; contexts, their totals, numbers of symbols, first keys, and whether they are used.
        self.levels: dict[int, list[np.ndarray]] = {}
        for k in range(order, 1, -1):
            if k < order:
                keys, which = np.unique(_last(keys, k + 1), return_inverse=True)
                counts = np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)
            context, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            self.levels[k] = [keys, counts, context, total, np.diff(np.append(first, len(keys))), first, np.ones(len(context), bool)]
        #: What the symbols of a context of order k have together at order j < k.
        self.shadow = {(1, 0): (pairs > 0) @ self.single}
        for k, (keys, _, _, _, _, first, _) in self.levels.items():
            for j in range(k):
                self.shadow[k, j] = np.add.reduceat(self.count(keys, j), first) if len(first) else np.zeros(0, np.int64)
        for k in range(2, order + 1):
            self.levels[k][-1] = self._worth(k)

    def _worth(self, k: int) -> np.ndarray:
        """Contexts of order k that would code their own symbols, each left out once,
        shorter than the contexts below do; the others are passed over."""
        keys, counts, context, total, kinds, first, _ = self.levels[k]
        if not len(keys):
            return np.zeros(0, bool)
        size = np.diff(np.append(first, len(keys)))
        below = self.log10(keys, k - 1)
        p = 10.0**below
        others = np.minimum(np.repeat(np.add.reduceat(p, first), size) - p, 1 - 1e-9)
        n = np.maximum(np.repeat(total, size) - 1, 1)
        again = counts * np.log10(np.maximum(2 * counts - 3, 1) / (2 * n))
        novel = np.log10(np.maximum(np.repeat(kinds, size) - 1, 0.5) / (2 * n)) + below - np.log10(1 - others)
        gain = np.where(counts > 1, again, novel) - counts * below
        return (np.add.reduceat(gain, first) > 0) & (total > 1)

    def count(self, keys: np.ndarray, k: int) -> np.ndarray:
        """How often the last k + 1 bytes of each key stand in the training texts."""
        if k == 1:
            return self.pairs[_byte(keys, 1), _byte(keys, 0)]
        if k == 0:
            return self.single[_byte(keys, 0)]
        known, counts = self.levels[k][:2]
        return _found(known, _last(keys, k + 1), counts)[0]

    def log10(self, keys: np.ndarray, top: int) -> np.ndarray:
        """Of each key, the probability of its last byte after up to ``top`` bytes before."""
        rows = len(keys)
        out, open_ = np.zeros(rows), np.ones(rows, bool)
        hidden = {k: np.zeros(rows, np.int64) for k in range(top)}
        kinds_hidden = np.zeros(rows, np.int64)
        for k in range(top, -1, -1):
            if k > 1:
                _, _, context, total, kinds, _, used = self.levels[k]
                n, at = _found(context, _last(keys, k + 1) >> np.uint64(8), np.where(used, total, 0))
                d = np.where(n > 0, kinds[at], 0) if len(context) else n
            elif k == 1:
                at = _byte(keys, 1)
                n, d = self.pairs.sum(axis=1)[at], (self.pairs > 0).sum(axis=1)[at]
            else:
                n, d = np.full(rows, self.single.sum()), np.full(rows, (self.single > 0).sum())
            left, kinds_left = n - hidden.get(k, 0), d - kinds_hidden
            use = open_ & (n > 0) & (left > 0) & (kinds_left > 0)
            count = self.count(keys, k)
            hit, miss = use & (count > 0), use & (count == 0)
            out[hit] += np.log10((2 * count[hit] - 1) / (2 * left[hit]))
            out[miss] += np.log10(kinds_left[miss] / (2 * left[miss]))
            open_ &= ~hit
            seen = np.flatnonzero(n > 0)
            kinds_hidden[seen] = d[seen]
            for j in range(k):
                if len(seen):
                    hidden[j][seen] = self.shadow[k, j][at[seen]]
        out[open_] -= np.log10(max(1, 256 - int((self.single > 0).sum())))
        return out


def _byte(keys: np.ndarray, back: int) -> np.ndarray:
    return ((keys >> np.uint64(8 * back)) & np.uint64(255)).astype(np.int64)


def _last(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * n) - 1) if n < 8 else keys


def _found(known: np.ndarray, asked: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the keys asked for (0: not known) and their places."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, values[at], 0), at


_ANSWERS = "unit long, kind int, bucket int, data binary, n long, v long"
_MERGED = "kind int, bucket int, a binary, b binary, bytes long"
_TOLD = "kind int, bucket int, a binary, data binary, n long, v long"


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each row, all distinct keys, their counts, and each row's keys' places."""
    asked = [expand_sorted(x) for x in table["a"].to_pylist()]
    counts = np.concatenate([expand(x, np.int64) for x in table["b"].to_pylist()])
    keys, which = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, which, counts)
    return asked, keys, totals, which


def _valued(kind: int, keys: np.ndarray, totals: np.ndarray, shared, order: int) -> np.ndarray:
    """What a unit is told of each key: its log-probability, or a word's count."""
    if kind != GRAMS:
        return totals
    pairs = np.zeros(65_536, np.int64)
    pairs[shared.value[0]] = shared.value[1]
    return Trie(keys, totals, pairs.reshape(256, 256), order).log10(keys, order).astype(np.float32)


def _told(kind: int, bucket: int, units: list[int], data: list[bytes], n: int = 0, v: int = 0) -> pa.Table:
    """Answers to units; -1 stands for the row of a bucket's totals."""
    rows = len(units)
    return pa.table({"unit": pa.array(units, pa.int64()), "kind": pa.array([TOTALS if u < 0 else kind for u in units], pa.int32()), "bucket": pa.array([bucket] * rows, pa.int32()), "data": pa.array(data, pa.binary()), "n": pa.array([n if u < 0 else 0 for u in units], pa.int64()), "v": pa.array([v if u < 0 else 0 for u in units], pa.int64())})


def _answerer(shared, order: int):
    """A whole bucket: its trie, and the answers to its units."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        asked, keys, totals, which = _merged(table)
        values = _valued(kind, keys, totals, shared, order)
        data = [squeeze(x) for x in np.split(values[which], np.cumsum([len(x) for x in asked])[:-1])]
        words = kind == WORDS
        out = _told(kind, bucket, [*table["unit"].to_pylist(), -1], [*data, b""], int(totals.sum()) * words, int((totals > 0).sum()) * words)
        del asked, keys, totals, which, values, data
        B.release()
        return out

    return run


def _merger(table: pa.Table) -> pa.Table:
    """One row for the rows of a group: their distinct keys and counts."""
    _, keys, totals, _ = _merged(table)
    a, b = squeeze_sorted(keys), squeeze(totals)
    return pa.table({"kind": table["kind"][:1], "bucket": table["bucket"][:1], "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary()), "bytes": pa.array([len(a) + len(b)], pa.int64())})


def _teller(shared, order: int):
    """A split bucket's keys and what units are told of them."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        _, keys, totals, _ = _merged(table)
        values, words = _valued(kind, keys, totals, shared, order), kind == WORDS
        out = {"kind": table["kind"][:1], "bucket": table["bucket"][:1], "a": pa.array([squeeze_sorted(keys)], pa.binary()), "data": pa.array([squeeze(values)], pa.binary())}
        return pa.table(out | {"n": pa.array([int(totals.sum()) * words], pa.int64()), "v": pa.array([int((totals > 0).sum()) * words], pa.int64())})

    return run


def _looker(units: pa.Table, told: pa.Table) -> pa.Table:
    """Answers to a group of a split bucket's units."""
    kind, bucket = told["kind"][0].as_py(), told["bucket"][0].as_py()
    keys, values = expand_sorted(told["a"][0].as_py()), expand(told["data"][0].as_py(), np.float32 if kind == GRAMS else np.int64)
    data = [squeeze(values[np.searchsorted(keys, expand_sorted(x))]) for x in units["a"].to_pylist()]
    return _told(kind, bucket, units["unit"].to_pylist(), data)


def _split_answers(asks: DataFrame, crowded: DataFrame, shared, order: int, group_bytes: int) -> DataFrame:
    """Answers of the buckets that no task may read whole; ``crowded``: their groups."""
    dealt = asks.join(crowded, ["kind", "bucket"]).withColumn("group", F.pmod(F.xxhash64("unit"), "groups"))
    now = checkpointed(dealt.groupBy("kind", "bucket", "group").applyInArrow(_merger, _MERGED))
    while True:  # rounds of merging, each at least halving the pieces, until a task can read them
        sizes = now.groupBy("kind", "bucket").agg(F.ceil(F.sum("bytes") / F.greatest(F.lit(group_bytes), 2 * F.max("bytes"))).alias("groups"))
        if sizes.filter("groups > 1").isEmpty():
            break
        pieces = now.join(sizes, ["kind", "bucket"]).withColumn("group", F.pmod(F.xxhash64("a"), "groups"))
        now = checkpointed(pieces.groupBy("kind", "bucket", "group").applyInArrow(_merger, _MERGED))
    told = checkpointed(now.groupBy("kind", "bucket").applyInArrow(_teller(shared, order), _TOLD))
    copies = told.join(crowded, ["kind", "bucket"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    by = ["kind", "bucket", "group"]
    answers = dealt.select(*by, "unit", "a").groupBy(*by).cogroup(copies.select(*by, "a", "data").groupBy(*by)).applyInArrow(_looker_of, _ANSWERS)
    totals = told.select(F.lit(-1).cast("long").alias("unit"), F.lit(TOTALS).alias("kind"), "bucket", F.lit(b"").alias("data"), "n", "v")
    return answers.unionAll(totals)


def _looker_of(units: pa.Table, told: pa.Table) -> pa.Table:
    return _looker(units, told) if units.num_rows else _told(0, 0, [], [])


def _adder(parts: int, order: int, n: int, v: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(texts["a"][0].as_py()).read_all()
        raw = texts["b"][0].as_py()
        size = int.from_bytes(raw[:8], "little")
        data = np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), np.uint8)
        unit = Unit(data, np.concatenate([[0], np.cumsum(rows["size"].to_numpy())]).astype(np.int64), order)
        by_key, by_word = unit.buckets(parts)
        logs, counts = np.zeros(len(unit.keys)), np.zeros(len(unit.words), np.int64)
        for kind, bucket, packed in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["data"].to_pylist()):
            if kind == GRAMS:
                logs[by_key == bucket] = expand(packed, np.float32)
            else:
                counts[by_word == bucket] = expand(packed, np.int64)
        docs = rows.num_rows
        each = np.repeat(logs, np.diff(np.append(unit.key_first, len(unit.key_doc))))
        score = np.bincount(unit.key_doc, weights=each, minlength=docs)
        known = np.bincount(unit.token_doc, weights=(counts > 0)[unit.word_of], minlength=docs).astype(np.int64)
        base = np.bincount(unit.token_doc, weights=np.log10(counts + 1)[unit.word_of], minlength=docs) - unit.n_tokens * np.log10(n + v + 1)
        own = [rows["id"].combine_chunks(), rows["held"].combine_chunks(), pa.array(unit.n_tokens, pa.int64()), pa.array(known), pa.array(np.full(docs, n), pa.int64()), pa.array(base), pa.array(score), pa.array(np.bincount(unit.key_doc, minlength=docs), pa.int64())]
        del unit, by_key, by_word, logs, counts, each, data, raw
        B.release()
        return pa.Table.from_arrays(own, names)

    return run


def score(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every row's log10 probability (``score``) under the model of the rows that are
    not held out, with the unigram ``base_score``, token counts and bytes scored."""
    if not 2 <= order <= MOST_ORDER:
        raise ValueError(f"an order from 2 to {MOST_ORDER}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, size // BUCKET_BYTES)
    folder = shared_folder(spark, "units")
    units = checkpointed(rows.mapInArrow(_cutter(parts, order), _ROWS), folder=folder, parts=("kind",))
    pairs = units.filter(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).groupBy("x.pair").agg(F.sum("x.pair_n").alias("n")).collect()
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in pairs], np.int64), np.array([r[1] for r in pairs], np.int64)))
    asks = units.filter(F.col("kind").isin(GRAMS, WORDS)).select("kind", "unit", "bucket", "a", "b")
    crowded = units.filter(F.col("kind").isin(GRAMS, WORDS)).groupBy("kind", "bucket").agg(F.ceil(F.sum("bytes") / group_bytes).alias("groups")).filter("groups > 1")
    crowded = checkpointed(crowded)
    whole, n_crowded = asks, crowded.count()
    if n_crowded:
        few = n_crowded <= BROADCAST_ROWS
        whole = asks.join(F.broadcast(crowded), ["kind", "bucket"], "left_anti") if few else salted_join(asks, crowded, ["kind", "bucket"], "unit", "left_anti")
    answers = whole.groupBy("kind", "bucket").applyInArrow(_answerer(shared, order), _ANSWERS)
    if n_crowded:
        answers = answers.unionAll(_split_answers(asks, F.broadcast(crowded) if few else crowded, shared, order, group_bytes))
    answers = checkpointed(answers)
    for kind in (GRAMS, WORDS):  # answered, so nothing reads them again
        discard(spark, f"{folder}/kind={kind}")
    n, v = answers.filter(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    texts = spark.read.schema(units.schema).parquet(folder).filter(F.col("kind") == TEXTS).select("unit", "a", "b")
    told = answers.filter(F.col("kind") != TOTALS).select("unit", "kind", "bucket", "data")
    return texts.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(_adder(parts, order, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
