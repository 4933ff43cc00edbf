"""MinHash near-dedup: universal hash minima, banding, verification, components.

1. Each document's distinct shingles (48-bit hashes) give its size, a 64-bit key of
   the whole set and ``BANDS * ROWS`` minima of universal hashes.
2. Documents with equal sets are one class from here on, whatever their number.
3. Each band's minima are a bucket key.  In every bucket the class that shares most
   buckets with others, as the original of a group of copies does, is the hub; the
   others are its candidates.
4. Pairs are verified twice: by the share of equal minima, then exactly on the full
   sets.
5. What is left are buckets whose members lie in several components.  There all
   members meet those outside the bucket's largest component, both sides cut into
   blocks of ``BLOCK`` members and ``BLOCK_BYTES`` of text on average, so a task
   holds two blocks at a time.  First only signatures meet, and each block pair names
   the members whose minima agree with another's; then those members' full sets meet,
   each pair in the first band that it shares, and the components that a link joins come
   out.
   So every pair that shares a bucket is connected or was compared: no cap on buckets,
   partners or candidates.
6. Links give components by large-star and small-star rounds.

A pair of similarity 0.8 shares no bucket with probability 4e-7 and falls below
``MIN_AGREE`` equal minima with one below 1e-6.

Defined results: a null or empty text or one without words has no shingles and is
linked with nothing; fewer words than a shingle has are one shingle; a pair of exactly
``percent`` is linked; a very long text is one set, in memory of a constant times its
size; repeated rows, and all rows of one id, are one vertex; a row with a null id is
linked with nothing and kept; an empty table gives an empty table; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _bytes as B
from millrace.llm._session import checkpointed
from millrace.llm.components import connected_components, dealt_join, salted_join

BANDS, ROWS = 28, 4
MIN_AGREE = 0.6
BLOCK, BLOCK_BYTES = 250, 4 << 20
#: Rows of a hub that meet one copy of its text.
DEAL = 2_000
EXACT_BYTES = 4 << 20
_GENERATOR = np.random.default_rng(77)
_A = _GENERATOR.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _GENERATOR.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, end to end; and their number in each."""
    starts, ends, counts = B.spans(B.SPACED[data], offs)
    words = B.Hasher(data, lower=True)(starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = B.row_of(counts)
    room = np.repeat(counts, counts) - (np.arange(len(words)) - first[doc])
    value = np.zeros(len(words), np.uint64)
    for k in range(width):
        inside = room > k
        value = np.where(inside, value * np.uint64(0x9E3779B97F4A7C15) + np.append(words[k:], np.zeros(min(k, len(words)), np.uint64)) + np.uint64(k + 1), value)
    whole = (room >= width) | (np.arange(len(words)) == first[doc])
    keys = (doc[whole].astype(np.uint64) << np.uint64(48)) | (B.mix(value[whole]) & _LOW48)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & _LOW48, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(counts))


def set_keys(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (0 for empty ones)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(elements + np.uint64(1)))])
    until = np.cumsum(sizes)
    return B.mix(sums[until] - sums[until - sizes] + sizes.astype(np.uint64)).astype(np.int64)


def minima(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of minima for each non-empty set: the high 32 bits of a*x + b over 2^64."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(first), BANDS * ROWS), np.uint32)
    if len(first):
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat(elements * _A[k] + _B[k], first) >> np.uint64(32)
    return out


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in B.text_chunks(batch.column(1)):
                elements, sizes = shingle_sets(data, offs, width)
                rows = np.full(hi - lo, -1)
                rows[sizes > 0] = np.arange(int((sizes > 0).sum()))
                signature = minima(elements, sizes).tobytes()
                size = 4 * BANDS * ROWS
                packed = [signature[k * size : (k + 1) * size] if k >= 0 else None for k in rows.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(set_keys(elements, sizes)), pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "cls", "sig"])

    return run


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            if not part.num_rows:
                continue
            own = part.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(len(own), BANDS, ROWS).astype(np.uint64)
            key = np.zeros((len(own), BANDS), np.uint64)
            for r in range(ROWS):
                key = B.mix(key * np.uint64(31) + sigs[:, :, r] + np.uint64(1))
            key = (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(own, BANDS))], ["band", "cls"])


def _exact(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (4, 5))
            batch = batch.filter(pa.array((x == y).mean(axis=1) >= MIN_AGREE))
            size = sum(np.diff(B.string_buffers(batch.column(c))[1]) for c in (2, 3)) if batch.num_rows else np.zeros(0, np.int64)
            for lo, hi in B.chunks(np.concatenate([[0], np.cumsum(size)]), EXACT_BYTES, 256):
                part = batch.slice(lo, hi - lo)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets = []
                for names, column in ((a, part.column(2)), (b, part.column(3))):
                    own: dict[int, np.ndarray] = {}
                    need = [k for name, k in {name: k for k, name in enumerate(names)}.items() if name not in held]
                    for first, end, data, offs in B.text_chunks(column.take(pa.array(need, pa.int64()))):
                        elements, sizes = shingle_sets(data, offs, width)
                        for k, s in zip(need[first:end], np.split(elements, np.cumsum(sizes)[:-1])):
                            own[names[k]] = s
                    sets.append(own)
                keep = []
                for x, y in zip(a, b):
                    s, t = (own[v] if v in own else held[v] for own, v in zip(sets, (x, y)))
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                held = {b[-1]: sets[1][b[-1]] if b[-1] in sets[1] else held[b[-1]]}  # pairs of a hub follow each other
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(ys: np.ndarray, xs: np.ndarray, y_comp: int, x_comp: np.ndarray, before: int) -> np.ndarray:
    """Places of the members of another component whose minima agree with those of one
    member, and that share no earlier band with it."""
    same = xs == ys
    near = np.flatnonzero((x_comp != y_comp) & (same.mean(axis=1) >= MIN_AGREE))
    return near[~same[near, : before * ROWS].reshape(len(near), before, ROWS).all(axis=2).any(axis=1)] if len(near) else near


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.column(3).to_numpy(), t.column(4).to_numpy(), np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint32).reshape(t.num_rows, BANDS * ROWS)


def _glance(left: pa.Table, right: pa.Table) -> pa.Table:
    """The members of a pair of blocks whose minima agree with one of the other block."""
    cells, sides, names = [], [], []
    if left.num_rows and right.num_rows:
        (x, xc, xs), (y, yc, ys) = _columns(left), _columns(right)
        seen, asked = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for k in range(len(y)):
            near = _agreeing(ys[k], xs, yc[k], xc, left.column(0)[0].as_py() & 31)
            seen[near] = True
            asked[k] = len(near) > 0
        names = [*x[seen].tolist(), *y[asked].tolist()]
        sides = [0] * int(seen.sum()) + [1] * int(asked.sum())
        cells = [[left.column(c)[0].as_py()] * len(names) for c in (0, 1, 2)]
    cells = cells or [[], [], []]
    return pa.table({**{n: pa.array(c, pa.int64()) for n, c in zip(("band", "i", "j"), cells)}, "side": pa.array(sides, pa.int32()), "cls": pa.array(names, pa.int64())})


def _meet(width: int, percent: int):
    """Components that a link joins, of the members named in two blocks of a bucket.

    A link between two components that earlier links of the same pair of blocks have
    joined adds nothing, so fewer pairs come out than members go in.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        side = table.column(6).to_numpy()
        left, right = (table.filter(pa.array(side == k)) for k in (0, 1))
        if left.num_rows and right.num_rows:
            (x, xc, xs), (y, yc, ys) = _columns(left), _columns(right)
            before = left.column(0)[0].as_py() & 31
            joined, place = np.unique(np.concatenate([xc, yc]), return_inverse=True)
            joined, x_at, y_at = np.arange(len(joined)), place[: len(x)], place[len(x) :]
            flat, sizes = _sets(left.column(7), width)
            asked, asked_sizes = _sets(right.column(7), width)
            first, until = np.cumsum(sizes) - sizes, np.cumsum(asked_sizes)
            for k in range(len(y)):
                near = _agreeing(ys[k], xs, yc[k], xc, before)
                near = near[joined[x_at[near]] != joined[y_at[k]]]
                if not len(near):
                    continue
                many, own = sizes[near], asked[until[k] - asked_sizes[k] : until[k]]
                own_first = np.cumsum(many) - many
                e = flat[np.repeat(first[near] - own_first, many) + np.arange(int(many.sum()))]
                at = np.minimum(np.searchsorted(own, e), len(own) - 1)
                both = np.add.reduceat((own[at] == e).astype(np.int64), own_first)
                for m in near[100 * both >= percent * (many + len(own) - both)].tolist():
                    if joined[x_at[m]] != joined[y_at[k]]:
                        joined[joined == joined[x_at[m]]] = joined[y_at[k]]
                        a.append(int(xc[m]))
                        b.append(int(yc[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, sorted, end to end; and their numbers."""
    parts = [shingle_sets(data, offs, width) for _, _, data, offs in B.text_chunks(column)]
    return np.concatenate([e for e, _ in parts]), np.concatenate([n for _, n in parts])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; documents whose sets
    share ``percent`` of their union are linked."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = checkpointed(rows.mapInArrow(_signer(shingle), "doc_id long, n_shingles long, cls long, sig binary"))
    known = signed.filter(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    classes = checkpointed(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))

    bands = classes.select("cls", "sig").mapInArrow(_bander, "band long, cls long")
    crowds = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = checkpointed(salted_join(bands, crowds, ["band"], "cls"))
    central = shared.groupBy("cls").agg(F.sum("n").alias("central"))
    ranked = shared.join(central, "cls")
    hubs = ranked.groupBy("band").agg(F.max_by("cls", F.struct("central", "cls")).alias("hub"))
    members = checkpointed(salted_join(shared, hubs, ["band"], "cls"))
    stars = members.filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()

    candidates = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "rep", "sig")
    texts = rows.join(candidates.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_keyer(shingle), "cls long, text string")
    texts = texts.groupBy("cls").agg(F.first("text").alias("text"))
    known_texts = checkpointed(candidates.select("cls", "sig").join(texts, "cls").withColumn("bytes", F.octet_length("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(known_texts.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.col("text").alias("text_a")), "a")
        # a hub may have any part of all pairs
        hub_texts = known_texts.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b"))
        wide = dealt_join(wide, hub_texts, "b", "a", DEAL)
        return wide.select("a", "b", "text_a", "text_b", "sig_a", "sig_b").mapInArrow(_exact(shingle, percent), "a long, b long")

    shared_ids = known.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("top")).filter("b <> top")
    links = known.join(shared_ids, "doc_id").filter("cls <> b").select(F.col("cls").alias("a"), "b")
    links = checkpointed(links.unionAll(verified(stars)))
    parts = checkpointed(connected_components(links, "a", "b"))

    placed = salted_join(members.filter("n > 2"), parts.withColumnRenamed("vertex", "cls").withColumnRenamed("component", "comp"), ["cls"], "band", "left").withColumn("comp", F.coalesce("comp", "cls"))
    by_part = placed.groupBy("band", "comp").agg(F.count("*").alias("k"))
    mixed = by_part.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("size")).filter("parts > 1")
    left = salted_join(placed, mixed.select("band", F.col("top.comp").alias("main"), "size"), ["band"], "cls")
    left = checkpointed(left.join(known_texts.select("cls", "bytes"), "cls").select("band", "cls", "comp", "main", "size", "bytes"))
    joined = None
    if not left.isEmpty():
        # both sides of a bucket in blocks; every block of one meets every block of the other
        asks = F.col("comp") != F.col("main")
        widths = left.groupBy("band").agg(*(F.greatest(F.ceil(F.count(x) / BLOCK), F.ceil(F.sum(F.when(x.isNotNull(), F.col("bytes"))) / BLOCK_BYTES)).alias(n) for n, x in (("n_i", F.col("cls")), ("n_j", F.when(asks, F.col("cls"))))))
        spread = salted_join(left, widths, ["band"], "cls").join(known_texts.select("cls", "sig"), "cls")
        zero = F.lit(0).cast("long")
        every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
        rows_i = spread.withColumn("i", F.pmod(F.xxhash64("cls"), "n_i")).withColumn("j", every("n_j")).select("band", "i", "j", "cls", "comp", "sig")
        rows_j = spread.filter(asks).withColumn("j", F.pmod(F.xxhash64("cls", F.lit(1)), "n_j")).withColumn("i", every("n_i")).select("band", "i", "j", "cls", "comp", "sig")
        rows_j = rows_j.select(*(F.col(c).alias(f"asking_{c}") for c in rows_j.columns))
        cell = ["band", "i", "j"]
        named = rows_i.groupBy(*cell).cogroup(rows_j.groupBy(*(f"asking_{c}" for c in cell))).applyInArrow(_glance, "band long, i long, j long, side int, cls long")
        named = checkpointed(named)
        comps = left.select("cls", "comp").distinct()
        met = named.join(comps, "cls").join(known_texts.select("cls", "sig", "text"), "cls").select(*cell, "cls", "comp", "sig", "side", "text").groupBy(*cell).applyInArrow(_meet(shingle, percent), "a long, b long")
        joined = checkpointed(met)
        joined = None if joined.isEmpty() else checkpointed(connected_components(joined, "a", "b"))

    whole = classes.select("cls", "rep", "copies").join(parts.withColumnRenamed("vertex", "cls"), "cls", "left")
    alone = (F.col("copies") == 1) & F.col("component").isNull()
    whole = whole.select("cls", "rep", alone.alias("alone"), F.coalesce("component", "cls").alias("component"))
    if joined is not None:
        whole = salted_join(whole, joined.select(F.col("vertex").alias("component"), F.col("component").alias("onto")), ["component"], "cls", "left")
        whole = whole.select("cls", "rep", (F.col("alone") & F.col("onto").isNull()).alias("alone"), F.coalesce("onto", "component").alias("component"))
    whole = whole.filter(~F.col("alone"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = salted_join(whole.select("cls", "component"), least, ["component"], "cls").select("cls", "component_id")
    out = salted_join(signed.select("doc_id", "n_shingles", "cls"), found, ["cls"], "doc_id", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (own.isNull() | (own == F.col("doc_id"))).alias("kept"))


def _keyer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in B.text_chunks(batch.column(1)):
                elements, sizes = shingle_sets(data, offs, width)
                out = pa.RecordBatch.from_arrays([pa.array(set_keys(elements, sizes)), batch.column(1).slice(lo, hi - lo)], ["cls", "text"])
                yield out.filter(pa.array(sizes > 0))

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that are near copies of a kept document; rows of one id stay together."""
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


#: The same by comparing all sets: for tables of some thousand rows.
NEAR_SQL = r"""
with recursive w as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (select distinct row, doc_id, array_to_string(words[i : i + 1], ' ') as shingle
      from (select *, unnest(range(1, greatest(len(words), 2))) as i from w where len(words) > 0)),
n as (select row, count(*) as n from s group by row),
sized as (select s.*, n.n from s join n using (row)),
pair as (select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as n_any, count(*) as n_common
         from sized a join sized b on a.shingle = b.shingle and a.row < b.row and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
         where a.doc_id is not null and b.doc_id is not null group by a.row, b.row, a.doc_id, b.doc_id, a.n, b.n),
edge as (select a, b from pair where 100 * n_common >= 80 * n_any union select b, a from pair where 100 * n_common >= 80 * n_any),
reach as (select doc_id as a, doc_id as b from w where len(words) > 0 and doc_id is not null union select reach.a, edge.b from reach join edge on reach.b = edge.a),
least as (select a, min(b) as least from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(case when len(words) > 0 then least end, w.doc_id)::bigint as component_id,
       w.doc_id is null or coalesce(case when len(words) > 0 then least end, w.doc_id) = w.doc_id as kept
from w left join n using (row) left join least on least.a = w.doc_id
"""
