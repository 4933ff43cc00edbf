"""Quality rules: repetition from suffix arrays, besides counts of words, symbols and lines.

The words of a chunk of whole documents become ids and all suffixes are sorted,
each document's apart.  Neighbours in that order share the longest prefixes, whose
lengths come from prefix hashes by bisection.  A position's longest repeat is the
larger of its two neighbours'; the spans of at least ``min_repeat`` words are the
longest-common-prefix intervals' occurrences, and their union is the repeated part
of the document.  Prefixes of three words or more give the repeated 3-word windows.

A document is kept if the base rules pass, the repeated part is at most
``max_fraction`` of its words and no repeat is longer than ``max_repeat`` words.

Defined results: a null or empty text has no words and fails; a repeat of exactly
``min_repeat`` words counts, a part of exactly ``max_fraction`` or a repeat of exactly
``max_repeat`` words passes; a very long text is sorted as a whole, in memory of some
50 times its size; repeated documents are judged alike; no document meets another; an
empty table gives an empty table; input columns called like an added column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _bytes as B
from millrace.llm._suffix import suffix_order

ADDED = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "repeat_fraction": "double",
    "longest_repeat": "long",
    "base_failed": "boolean",
    "kept": "boolean",
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def common_prefixes(words: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b share; ``room``: words left in the document."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words | np.uint64(1)) * B.powers(len(words)), out=sums[1:])
    back = B.powers(len(words) + 1, inverse=True)
    most = np.minimum(room[a], room[b])
    shared = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
    while step:
        n = shared + step
        fits = np.flatnonzero(n <= most)
        p, q, end = a[fits], b[fits], n[fits]
        same = (sums[p + end] - sums[p]) * back[p] == (sums[q + end] - sums[q]) * back[q]
        shared[fits[same]] = end[same]
        step >>= 1
    return shared


def longest_repeats(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word of documents laid end to end: how many words from there on
    stand at another place of the same document too."""
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    _, ids = np.unique(words, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    doc = B.row_of(counts)
    room = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    following = np.where(room > 1, np.append(ids[1:], 0), 0)
    wide = int(ids.max()).bit_length()
    if 2 * wide + int(doc[-1]).bit_length() <= 63:
        keys, width = (((doc << wide) | ids) << wide) | following, 2
    else:
        keys, width = (doc << wide) | ids, 1
    # a suffix ends with its document: what follows is ordered by the next document's number and never ties across documents
    order = suffix_order(keys, width)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((doc[a] == doc[b]) & (ids[a] == ids[b]))
    shared = common_prefixes(words, room, a[near], b[near])
    np.maximum.at(out, a[near], shared)
    np.maximum.at(out, b[near], shared)
    return out


def measure(data: np.ndarray, offs: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of every document of a chunk."""
    rows = len(offs) - 1
    starts, ends, counts = B.spans(B.SPACED[data], offs)
    first = np.concatenate([[0], np.cumsum(counts)])
    hasher = B.Hasher(data)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offs[1:]] - total[offs[:-1]]

    chars = per_row(B.SPACED[data] & ((data & 0xC0) != 0x80))
    symbols = per_row(SYMBOLS[data])

    line_starts, line_ends, _ = B.spans(data != 10, offs)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    lines = hasher(line_starts, line_ends)
    order = np.lexsort((lines, line_doc))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    duplicates = np.bincount(line_doc[order][again], minlength=rows)

    repeats = longest_repeats(hasher(starts, ends), counts)
    doc = B.row_of(counts)

    def covered(least: int, exact: bool) -> np.ndarray:
        at = np.flatnonzero(repeats >= least)
        inside = B.union_length(at, at + (least if exact else repeats[at]), len(starts))
        return np.bincount(doc[inside], minlength=rows)

    longest = np.zeros(rows, np.int64)
    filled = np.flatnonzero(counts)
    if len(filled):
        longest[filled] = np.maximum.reduceat(repeats, first[:-1][filled])
    return {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": covered(3, True), "covered": covered(min_repeat, False), "longest_repeat": longest}


def _measurer(text_col: str, names: list[str], rules: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = dict(zip(batch.schema.names, batch.columns))
            for lo, hi, data, offs in B.text_chunks(have[text_col]):
                m = measure(data, offs, rules["min_repeat"])
                n = m["n_words"]
                m["repeat_fraction"] = m.pop("covered") / np.maximum(n, 1)
                m["base_failed"] = (n < rules["min_words"]) | (100 * m["n_repeat_words"] > rules["max_repeat_percent"] * n)
                m["kept"] = ~m["base_failed"] & (m["repeat_fraction"] <= rules["max_fraction"]) & (m["longest_repeat"] <= rules["max_repeat"])
                own = {k: pa.array(v if v.dtype in (bool, float) else v.astype(np.int64)) for k, v in m.items()}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else have[c].slice(lo, hi - lo) for c in names], names)

    return run


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 10, max_fraction: float = 0.3, max_repeat: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed and kept; lengths are in words."""
    rules = {"min_words": min_words, "max_repeat_percent": max_repeat_percent, "min_repeat": min_repeat, "max_fraction": max_fraction, "max_repeat": max_repeat}
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in ADDED.items())])
    return out.mapInArrow(_measurer(text_col, schema.fieldNames(), rules), schema)


#: A repeat of 10 words or more is a run of 10-word windows found twice or more; one of
#: more than 200 words holds a 201-word window found twice.
RULES_SQL = r"""
with w as (select row_number() over () as row, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select row, size, i, array_to_string(words[i : i + size - 1], ' ') as span
        from (select row, words, size, unnest(range(1, len(words) - size + 2)) as i from w, (values (3), (10)) t(size) where len(words) >= size)),
rep as (select row, size, i, count(*) over (partition by row, size, span) as n from win),
cov as (select row, size, count(distinct j) as n from (select row, size, unnest(range(i, i + size)) as j from rep where n > 1) group by row, size),
c as (select row, sum(n) filter (where size = 3) as n3, sum(n) filter (where size = 10) as n10 from cov group by row),
long as (select row, 1 as n201 from (select row, span from (
           select row, array_to_string(words[i : i + 200], ' ') as span from (select row, words, unnest(range(1, len(words) - 199)) as i from w join c using (row) where n10 > 201 and len(words) > 201))
         group by row, span having count(*) > 1) group by row),
lines as (select row, unnest(string_split(text, chr(10))) as line from w),
dup as (select row, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
r as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
             coalesce(n3, 0)::bigint as n_repeat_words, coalesce(n10, 0) as n10, coalesce(n201, 0) as n201
      from w left join c using (row) left join long using (row) left join dup using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n10 / greatest(n_words, 1)::double <= 0.3 and n201 = 0 as kept
from r
"""
