"""Benchmark decontamination by an FM-index over every shard of documents.

A shard (``SHARD`` bytes of whole documents) becomes word ids; its suffixes are
sorted, the Burrows-Wheeler transform is kept as a wavelet matrix, and all windows
of the benchmark are searched backwards at once.  Occurrences are located by
walking to sampled suffix positions, and their word spans are merged.

Words that no benchmark item has cannot be part of an occurrence, so the index
holds only the runs of known words that are as long as the shortest window,
set apart by separators; this loses nothing.

The benchmark is searched in groups of at most ``group_bytes`` of text, each sent
to the executors once; between groups the found spans are checkpointed, so what
is broadcast has a fixed bound at any benchmark size.

Defined results: a null or empty text or one without words has no hits; an item
without words has no windows; items with a null id are not searched; rows of one
item id are one item; a window of several items counts for each of them; a very long
text is a shard of its own, in memory of a constant times its size; repeated documents
each get their result; empty tables work on both sides; input columns called like an
added column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _bytes as B
from millrace.llm._session import checkpointed
from millrace.llm._suffix import suffix_order

SHARD = 3 << 20
SAMPLE = 8
ADDED = {"n_words": "long", "hits": "array<struct<start:int,end:int>>", "items": "array<string>"}


class FMIndex:
    """Counts and finds patterns in a text of ids from 1; 0 separates and ends it."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = self.n = len(text)
        stops = np.flatnonzero(text == 0)
        keys = text.astype(np.int64) + len(stops)
        keys[stops] = np.arange(len(stops))  # each separator differs, so no repeat runs over one
        order = suffix_order(keys)
        bwt = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])
        marked = (order % sample == 0) | (bwt == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]
        self.levels = []
        for bit in range(max(1, int(text.max(initial=0)).bit_length()) - 1, -1, -1):
            one = (bwt >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            bwt = np.concatenate([bwt[~one], bwt[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the transform."""
        lo, hi = np.zeros_like(at), at
        for bit, zeros, total in self.levels:
            one = (symbol >> bit) & 1 == 1
            z_lo, z_hi = zeros[lo], zeros[hi]
            lo, hi = np.where(one, total + lo - z_lo, z_lo), np.where(one, total + hi - z_hi, z_hi)
        return hi - lo

    def step(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that are one symbol longer (not over a separator)."""
        symbol, lo, hi = np.zeros_like(row), np.zeros_like(row), row
        for bit, zeros, total in self.levels:
            z_lo, z_hi = zeros[lo], zeros[hi]
            one = zeros[hi + 1] == z_hi
            symbol |= one.astype(symbol.dtype) << bit
            lo, hi = np.where(one, total + lo - z_lo, z_lo), np.where(one, total + hi - z_hi, z_hi)
        return self.below[symbol] + hi - lo

    def search(self, words: np.ndarray, starts: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and their ranges of suffixes.

        A pattern is ``length`` of ``words`` from one of ``starts``.  Patterns are in the
        order of their words from the last one back, and ``shared`` has how many of these
        each has in common with the one before; a common ending is searched once.
        """
        from_, to = np.zeros(1, np.int64), np.full(1, len(starts), np.int64)
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for k in range(length - 1, -1, -1):
            leaders = np.flatnonzero(shared < length - k)
            first = np.searchsorted(leaders, from_)
            many = np.searchsorted(leaders, to) - first
            parent = B.row_of(many)
            place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(parent))
            child = leaders[place]
            c = words[starts[child] + k]
            known = np.flatnonzero(c < len(self.below) - 1)
            c, child, place, parent = c[known], child[known], place[known], parent[known]
            lo, hi = self.below[c] + self.rank(c, lo[parent]), self.below[c] + self.rank(c, hi[parent])
            found = hi > lo
            from_, to, lo, hi = child[found], np.append(leaders, len(starts))[place[found] + 1], lo[found], hi[found]
            if not len(from_):
                break
        return from_, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(row):
            done = self.marks[row + 1] > self.marks[row]
            out[at[done]] = self.samples[self.marks[row[done]]] + steps
            row, at, steps = self.step(row[~done]), at[~done], steps + 1
        return out


def _backward_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length`` words that end at each place, compared from the last one
    back, by doubling; of no meaning where fewer stand before."""
    rank, have = words.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)  # the earlier part may overlap the later one
        rank[step:] = rank[step:] * (rank.max() + 1) + rank[:-step] if step < len(rank) else 0
        by = np.argsort(rank)
        sorted_ = rank[by]
        new = np.zeros(len(by), bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
        rank[by] = np.cumsum(new, out=sorted_)
        have += step
    return rank


class Phrases:
    """Windows of a group of benchmark items: a vocabulary, the items' words as its ids,
    and of each length of window where they begin and whose they are.  All are arrays of
    numbers, some 20 bytes a window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes, each = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offs in B.text_chunks(pa.array([text for _, text in items], pa.string()), 1 << 20):
            starts, ends, counts = B.spans(B.ALNUM[data], offs)
            hashes.append(B.Hasher(data, lower=True)(starts, ends))
            each.append(counts)
        flat, counts = np.concatenate(hashes), np.concatenate(each)
        del hashes
        self.vocabulary = np.unique(flat)
        self.words = (np.searchsorted(self.vocabulary, flat) + 1).astype(np.int32)
        del flat
        self.names = sorted({name for name, _ in items})
        rank = {name: k for k, name in enumerate(self.names)}
        owner = np.array([rank[name] for name, _ in items], np.int32)
        first, size = np.cumsum(counts) - counts, np.minimum(counts, window)
        #: By length: the windows' first words, the words shared with the window before, and their owners from and to.
        self.patterns: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == length)
            many = counts[own] - length + 1
            begin = (np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))).astype(np.int32)
            who = np.repeat(owner[own], many)
            by = np.argsort(_backward_ranks(self.words, length)[begin + length - 1])
            begin, who = begin[by], who[by]
            shared, same = np.zeros(len(begin), np.int32), np.ones(len(begin) - 1, bool)
            for k in range(length - 1, -1, -1):
                column = self.words[begin + k]
                same &= column[1:] == column[:-1]
                shared[1:] += same
            new = shared < length
            new[0] = True
            pair = np.unique((np.cumsum(new) - 1) * len(self.names) + who)
            self.patterns[length] = begin[new], shared[new], np.searchsorted(pair, np.arange(int(new.sum()) + 1) * len(self.names)).astype(np.int32), (pair % len(self.names)).astype(np.int32)
        self.shortest = min(self.patterns, default=0)

    def find(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each document's words, which words are hit, and pairs of a document
        and a name's place, in order."""
        starts, ends, counts = B.spans(B.ALNUM[data], offs)
        first = np.concatenate([[0], np.cumsum(counts)])
        none = np.zeros(0, np.int64)
        nothing = first, np.zeros(len(starts), bool), none, none
        if not self.shortest or not len(starts):
            return nothing
        hashes = B.Hasher(data, lower=True)(starts, ends)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        run_from, run_to, _ = B.spans(ids > 0, first)
        long = run_to - run_from >= self.shortest
        run_from, run_to = run_from[long], run_to[long]
        if not len(run_from):
            return nothing
        length = run_to - run_from + 1
        shift = np.repeat(run_from - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        origin = np.arange(int(length.sum())) + shift
        text = ids[np.minimum(origin, len(ids) - 1)]
        text[np.cumsum(length) - 1] = 0
        index = FMIndex(text)
        change, pairs = np.zeros(len(starts) + 1, np.int64), [none]
        for size, (begin, shared, until, owners) in self.patterns.items():
            which, lo, hi = index.search(self.words, begin, shared, size)
            many = hi - lo
            rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            word = origin[index.locate(rows)]
            change += np.bincount(word, minlength=len(change)) - np.bincount(word + size, minlength=len(change))
            seen = np.unique((np.searchsorted(first, word, "right") - 1) * len(begin) + np.repeat(which, many))
            doc, pattern = seen // len(begin), seen % len(begin)
            each = until[pattern + 1] - until[pattern]
            name = owners[np.repeat(until[pattern] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            pairs.append(np.unique(np.repeat(doc, each) * len(self.names) + name))
        pair = np.unique(np.concatenate(pairs))
        return first, np.cumsum(change[:-1]) > 0, pair // len(self.names), pair % len(self.names)


def _groups(items: DataFrame, item_id: str, item_text: str, group_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark as lists of (id, text) of about ``group_bytes`` at most."""
    known = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = known.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = max(1, -(-total // group_bytes))
    for k in range(parts):
        part = known.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) if parts > 1 else known
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def _searcher(shared, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        items = pa.array(phrases.names, pa.string())
        for batch in batches:
            have = dict(zip(batch.schema.names, batch.columns))
            for lo, hi, data, offs in B.text_chunks(have[text_col], SHARD):
                first, hit, doc, name = phrases.find(data, offs)
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), items.take(pa.array(name)))
                if "hits" in have:  # of earlier groups of items
                    before = have["hits"].slice(lo, hi - lo), have["items"].slice(lo, hi - lo)
                    row = B.row_of(before[0].value_lengths().to_numpy())
                    spans = before[0].flatten()
                    at, to = (first[row] + spans.field(c).to_numpy() for c in ("start", "end"))
                    hit |= B.union_length(at, to, len(hit))
                    found = pa.array([sorted({*x, *y}) for x, y in zip(found.to_pylist(), before[1].to_pylist())], pa.list_(pa.string()))
                begin, end, each = B.spans(hit, first)
                start = first[B.row_of(each)]
                spans = pa.StructArray.from_arrays([pa.array(begin - start, pa.int32()), pa.array(end - start, pa.int32())], ["start", "end"])
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), spans)
                own = {"n_words": pa.array(np.diff(first), pa.int64()), "hits": hits, "items": found}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else have[c].slice(lo, hi - lo) for c in names], names)

    return run


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", group_bytes: int = 16 << 20, then: Callable | None = None) -> DataFrame:
    """``docs`` with n_words, hits (merged spans of words) and items (ids as sorted strings).

    ``then``: what the workers that search the last group of items do with its batches,
    which keep their columns.
    """
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in ADDED.items())])
    search = None
    for group in _groups(items, item_id, item_text, group_bytes):
        if search:
            out = checkpointed(out.mapInArrow(search, schema))
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(group, window))
        search = _searcher(shared, text_col, schema.fieldNames())
    return out.mapInArrow(_chained(search, then) if then else search, schema)


def _chained(first: Callable, then: Callable):
    """Both steps in one worker; a second ``mapInArrow`` in a stage would start another
    one for each task, and Spark keeps them all for the stages that follow."""
    return lambda batches: then(first(batches))


def _cutter(text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = dict(zip(batch.schema.names, batch.columns))
            texts, kind = have[text_col].to_pylist(), have[text_col].type
            for k, spans in enumerate(have["hits"].to_pylist()):
                if spans:
                    raw = texts[k].encode()
                    data = np.frombuffer(raw, np.uint8)
                    starts, ends, _ = B.spans(B.ALNUM[data], np.array([0, len(data)]))
                    stays, at = [], 0
                    for x in spans:
                        stays.append(raw[at : starts[x["start"]]])
                        at = ends[x["end"] - 1]
                    texts[k] = b"\n".join([*stays, raw[at:]]).decode()
            have[text_col] = pa.array(texts, kind)
            yield pa.RecordBatch.from_arrays([have[c] for c in names], names)

    return run


def remove_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the merged spans of benchmark passages, each now a line break.

    Documents of which no word is left go; all others stay, untouched where
    nothing was found.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_dc_rest") if rest else F.lit(0).alias("_dc_rest"), F.col(text_col).alias("_dc_text"))
    names = [*rows.columns, *ADDED]
    cut = find_passages(rows, items, text_col="_dc_text", then=_cutter("_dc_text", names), **options)
    left = (F.size("hits") == 0) | (F.regexp_replace(F.lower("_dc_text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "") != "")
    return cut.filter(left).select(*(F.col("_dc_text").alias(c) if c == text_col else F.col("_dc_rest").getField(c).alias(c) for c in docs.columns))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the hash of the items of each document."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


FIND_SQL = r"""
with w as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
      from benchmark where item_id is not null and text is not null),
win as (select distinct item_id, least(len(words), 10) as size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as phrase
        from (select *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
sizes as (select distinct size from win),
doc as (select row_number() over () as row, * from w),
pos as (select row, size, i, array_to_string(words[i : i + size - 1], ' ') as phrase
        from (select row, words, size, unnest(range(1, len(words) - size + 2)) as i from doc, sizes where len(words) >= size)),
hit as (select distinct row, size, i, item_id from pos join win using (size, phrase)),
cover as (select row, count(distinct j) as n from (select row, unnest(range(i, i + size)) as j from hit) group by row),
item as (select row, count(*) as n, string_agg(name, ',' order by name) as names from (select distinct row, item_id::varchar as name from hit) group by row)
select doc_id, len(words)::bigint as n_words, coalesce(cover.n, 0)::bigint as n_hit, coalesce(item.n, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(cover.n, 0) > 0 as contaminated
from doc left join cover using (row) left join item using (row)
"""
