"""Token-id output: a public tokenizer's ids, Simple-8b coded in blocks.

Documents are dealt by ranges of their id, sorted, encoded and written as blocks
of whole documents in ascending order.  A block is

    magic, documents, ids, words of lengths      4 little-endian uint32
    the documents' lengths, Simple-8b            uint64 words
    the ids, Simple-8b                           uint64 words

and stands in a row of a Parquet file with its shard, its number there and its
document ids, so Spark's committer makes the files safe against lost tasks and any
store can hold them.  The lengths are the block's offsets: one prefix sum gives
every document's place and all words of a selector are decoded at once.

A Simple-8b word keeps a selector in its top four bits and packs as many of the
next values as fit; selector 0 is the escape for a value of 60 bits or more, which
follows as a word of its own.

Any tokenizer file serves.  Where its normalizer, its pre-tokenizer and its model's
settings are those of ``CUTTING``, texts are cut at ASCII white space, which such a
tokenizer drops, and where it always cuts itself (beside a digit, between letters and
signs); the pieces are encoded once and kept in a bounded cache, which gives the ids of
the whole text.  With any other file whole texts are encoded.

Defined results: a null or empty text is the end id alone; rows of one id are
ordered by a hash of their text; null ids come first; a very long text is encoded
as a whole, in memory of a constant times its size, and is a block of its own; equal
texts give equal ids; an empty table gives no blocks; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import _bytes as B
from millrace.llm._session import shared_folder

#: Values packed in a word and bits of each, by selector; 0 is the escape.
PACKED = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = 0x38425331
BLOCK_IDS = 1 << 16
CACHE_WORDS = 400_000


_BITS = np.searchsorted(1 << np.arange(17), np.arange(1 << 16), "right").astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of non-negative integers below 2^64."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    values = values.astype(np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    powers = np.uint64(1) << np.arange(60, dtype=np.uint64)
    if values.max() < 1 << 16:
        bits = _BITS[padded]
    else:
        bits = np.searchsorted(powers, padded, "right").astype(np.uint8)
    bits[padded >> np.uint64(60) > 0] = 64
    widest = {1: bits}
    selector = np.full(n, 14, np.uint8)
    for s in range(13, 0, -1):
        count, width = PACKED[s]
        big = max(k for k in widest if k < count)
        # the window of ``count`` is covered by two windows of the next smaller size, or that and single steps
        now = widest[big]
        if 2 * big >= count:
            now = np.maximum(now[: len(now) - (count - big)], now[count - big :])
        widest = {**widest, count: now}
        selector[now[:n] <= width] = s
    selector[bits[:n] > 60] = 0
    steps = np.array([1, *(c for c, _ in PACKED[1:])])[selector].tolist()
    at, firsts = 0, []
    while at < n:
        firsts.append(at)
        at += steps[at]
    first = np.array(firsts)
    used = selector[first]
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(used == 0)[:-1]])
    out = np.zeros(len(first) + int((used == 0).sum()), np.uint64)
    for s in np.unique(used).tolist():
        rows = first[used == s]
        if s == 0:
            out[place[used == 0] + 1] = values[rows]
            continue
        count, width = PACKED[s]
        word = np.full(len(rows), s << 60, np.uint64)
        for j in range(count):
            word |= padded[rows + j] << np.uint64(j * width)
        out[place[used == s]] = word
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of Simple-8b words."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escape = np.flatnonzero(selector == 0)
    at = -1
    for k in escape.tolist():  # a raw word may look like an escape
        if k != at:
            at = k + 1
            raw[at] = True
    heads = np.flatnonzero(~raw) if len(escape) else np.arange(len(words))
    # raw words may look like heads of any selector; those after an escape were marked above
    used = selector[heads]
    counts = np.array([1, *(c for c, _ in PACKED[1:])])[used]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(used).tolist():
        rows = first[used == s]
        if s == 0:
            out[rows] = words[heads[used == 0] + 1]
            continue
        count, width = PACKED[s]
        mask, word = np.uint64((1 << width) - 1), words[heads[used == s]]
        for j in range(count):
            out[rows + j] = (word >> np.uint64(j * width)) & mask
    return out[:n]


def encode_block(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    head = pack(lengths)
    return np.array([MAGIC, len(lengths), len(ids), len(head)], "<u4").tobytes() + head.astype("<u8").tobytes() + pack(ids).astype("<u8").tobytes()


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids."""
    magic, docs, ids, head = np.frombuffer(block, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    words = np.frombuffer(block, "<u8", offset=16)
    return unpack(words[:head], docs).astype(np.int64), unpack(words[head:], ids)


_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _WIDE, _SPACE = range(6)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58], _KIND[128:], _KIND[39], _KIND[~B.SPACED] = _DIGIT, _WIDE, _APOSTROPHE, _SPACE
#: Pairs of neighbours between which the tokenizer always cuts; never beside what isn't ASCII, nor after an apostrophe.
_CUT = np.zeros((6, 6), bool)
_CUT[_DIGIT, [_LETTER, _DIGIT, _SIGN, _APOSTROPHE]] = _CUT[[_LETTER, _SIGN], _DIGIT] = True
_CUT[_LETTER, [_SIGN, _APOSTROPHE]] = _CUT[_SIGN, _LETTER] = True
#: Letters of which a piece is one unit for the model once it is lower case: composed, so normalization leaves them.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


#: The settings of a tokenizer file for which the cuts above are proven.
CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def cuts_are_proven(tokenizer) -> bool:
    """Whether pieces give the ids of whole texts: the settings are ``CUTTING``'s, nothing
    is truncated or padded, and every added token holds a bar and is matched as it is."""
    told = json.loads(tokenizer.to_str())
    told["model"] = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
    plain = all("|" in x["content"] and not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) for x in told["added_tokens"])
    return plain and told["truncation"] is None and told["padding"] is None and all(told[k] == v for k, v in CUTTING.items())


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + k for k, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and ids of every text, each with the end id."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        ids = [np.array([*x.ids, self.end_id], np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([len(x) for x in ids], np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)


class WordEncoder:
    """Ids of whole texts, by way of the ids of their pieces."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id, self.letters = tokenizer, end_id, _byte_letters()
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, piece: str) -> list[int]:
        if not _PLAIN.fullmatch(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        piece = piece.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.model.tokenize(piece)]

    def rows(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Places in the cache of distinct pieces; ``letters``: those of ASCII letters only."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        keys, known = hashes.tolist(), self.known
        new = [k for k, key in enumerate(keys) if key not in known]
        if new:
            raw, low, tokenize, of = data.tobytes(), B.LOWER[data].tobytes(), self.model.tokenize, self.ids_of
            flat: list[int] = []
            sizes = []
            for s, e, plain in zip(starts[new].tolist(), ends[new].tolist(), letters[new].tolist()):
                ids = [x.id for x in tokenize(low[s:e].decode())] if plain else of(raw[s:e].decode())
                flat += ids
                sizes.append(len(ids))
            size = np.array(sizes, np.int64)
            at = len(self.pool) + np.cumsum(size) - size
            known.update(zip([keys[k] for k in new], range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts, self.sizes = np.concatenate([self.starts, at]), np.concatenate([self.sizes, size])
            self.pool = np.concatenate([self.pool, np.array(flat, np.uint32)])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and ids of every text, each with the end id."""
        kind = _KIND[data]
        cuts = np.flatnonzero(_CUT.ravel().take(kind[:-1] * np.uint8(6) + kind[1:])) + 1
        words, _, _ = B.spans(kind != _SPACE, offs)
        bars = np.flatnonzero(data == 124)
        if len(bars):  # words that may hold a special token's string stay whole and as they are
            barred = np.unique(np.searchsorted(words, bars, "right"))
            cuts = cuts[~np.isin(np.searchsorted(words, cuts, "right"), barred)]
        starts, ends, counts = B.spans(kind != _SPACE, offs, cuts)
        hashes = B.Hasher(data, lower=True)(starts, ends)
        special = np.concatenate([[0], np.cumsum((kind == _WIDE) | (data == 124))])
        cased = np.flatnonzero(special[ends] > special[starts])
        if len(cased):
            hashes[cased] = B.Hasher(data)(starts[cased], ends[cased])
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        at_start, at_end = starts[at], ends[at]
        letters = (kind[at_start] == _LETTER) & (special[at_end] == special[at_start])
        word = self.rows(distinct, data, at_start, at_end, letters)[which] if len(distinct) else np.zeros(0, np.int64)
        sizes = self.sizes[word]
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[word] - until[:-1], sizes) + np.arange(int(until[-1]))]
        last = until[np.cumsum(counts)]
        return np.diff(last, prepend=0) + 1, np.insert(ids, last, np.uint32(self.end_id))


_ENCODERS: dict[tuple[str, int], WordEncoder | TextEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    """One for each process, with its cache."""
    if (path, end_id) not in _ENCODERS:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        _ENCODERS[path, end_id] = (WordEncoder if cuts_are_proven(tokenizer) else TextEncoder)(tokenizer, end_id)
    return _ENCODERS[path, end_id]


def _writer(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number = encoder(path, end_id), 0
        for batch in batches:
            for lo, hi, data, offs in B.text_chunks(batch.column(1)):
                lengths, ids = tool.encode(data, offs)
                last = np.cumsum(lengths)
                rows: dict[str, list] = {"block": [], "n_docs": [], "n_ids": [], "doc_ids": [], "payload": []}
                a = 0
                while a < len(lengths):
                    before = int(last[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(last, before + block_ids, "right")))
                    own = ids[before : int(last[b - 1])]
                    for k, v in (("block", number), ("n_docs", b - a), ("n_ids", len(own)), ("doc_ids", batch.column(0)[lo + a : lo + b]), ("payload", encode_block(lengths[a:b], own))):
                        rows[k].append(v)
                    a, number = b, number + 1
                ids_column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows["n_docs"])]), pa.int32()), pa.concat_arrays(rows["doc_ids"]))
                yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array(rows["n_docs"], pa.int64()), pa.array(rows["n_ids"], pa.int64()), ids_column, pa.array(rows["payload"], pa.binary())], list(rows))

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the blocks of all documents, in ascending order of ids, below ``folder``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(max(1, 2 * rows.rdd.getNumPartitions()), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    blocks = dealt.mapInArrow(_writer(tokenizer, end_id, block_ids), "block long, n_docs long, n_ids long, doc_ids array<long>, payload binary")
    blocks.withColumn("shard", F.spark_partition_id()).write.mode("errorifexists").option("compression", "uncompressed").parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, ids = decode_block(batch.column(2)[k].as_buffer())
            raw, until = memoryview(ids.astype("<u4")).cast("B"), np.concatenate([[0], np.cumsum(lengths)])
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(until[:-1].tolist(), until[1:].tolist())]
            n = len(lengths)
            keys = [pa.array(np.full(n, batch.column(c)[k].as_py()), pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, batch.column(3)[k].values, pa.array(until[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, from the blocks: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(folder)
    sizes = blocks.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select(F.col("shard").cast("long"), "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    each = blocks.select(F.col("shard").cast("long"), "block", "payload", "doc_ids").mapInArrow(_reader, "shard long, block long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Writes the documents to a new folder below the shared one and reads them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id, **options)
    return read_tokens(docs.sparkSession, folder)
