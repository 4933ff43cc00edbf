"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets.

``mix`` decides how often each document is taken so that every source gives its
share of the words.  The plan is DataFrame operations only:

1. each row gets a key that is random but repeatable (md5 of seed, id and text) and
   its size, stored as a table, so texts are read once; the key's first hex digits,
   as many as the size asks for, cut a source into even ranges of ``RANGE_WORDS``;
2. one exchange deals the rows by (source, range); inside a range a window sums
   the sizes in key order, and the ranges' totals, a small table, give every
   range its offset: together a distributed prefix sum over a whole source;
3. the same totals give the sources' sizes and, by water filling, their targets;
4. a row is taken ``floor(target / source size)`` times and once more if its
   middle lies before the rest of the budget, so that a source misses its target
   by half a document at most.

No row meets all others of its source, so a source may hold any part of the rows.

Defined results: a null or empty text has size 0; a null source is a source of its
own, last in order; rows with equal id and text have equal keys and may differ in
``taken`` where a budget ends between them; a very long text counts like any other and
may alone take its source past or short of its budget by half its size; a source of size
0 has target 0; an empty table gives an empty table; input columns called like an added
column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._session import checkpointed

#: Words of a range, the rows that one window meets.
RANGE_WORDS = 1 << 21
#: A source has 16 ** LEAST_DIGITS ranges at least, so that its rows spread over many tasks.
LEAST_DIGITS = 3
ADDED = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None, range_words: int = RANGE_WORDS) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words) and copies (times taken).

    ``weights`` are dealt to the sources in code-point order, repeating.
    ``carry``: the columns of ``docs`` wanted in the result, all by default; without the
    text nothing but keys and sizes is stored and exchanged.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = docs.select(
        *(F.col(f"`{c}`") for c in kept),
        word_count(text).alias("_mx_size"),
        F.coalesce(source, F.lit("")).alias("_mx_source"),
        source.isNull().alias("_mx_null"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))).alias("_mx_key"),
    )
    sized = checkpointed(sized)
    largest = sized.groupBy("_mx_null", "_mx_source").agg(F.sum("_mx_size").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = max(LEAST_DIGITS, -(-(largest // range_words).bit_length() // 4))
    rows = sized.withColumn("_mx_range", F.substring("_mx_key", 1, digits))
    by = ["_mx_null", "_mx_source", "_mx_range"]
    totals = rows.groupBy(*by).agg(F.sum("_mx_size").alias("_mx_sum"))
    before = Window.partitionBy("_mx_null", "_mx_source").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_mx_offset", F.coalesce(F.sum("_mx_sum").over(before), F.lit(0)))
    plan = offsets.join(targets(totals, weights, max_epochs), ["_mx_null", "_mx_source"]).drop("_mx_sum")
    inside = Window.partitionBy(*by).orderBy("_mx_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mx_before", F.coalesce(F.sum("_mx_size").over(inside), F.lit(0))).join(plan, by)
    once_more = F.col("_mx_offset") + F.col("_mx_before") + F.col("_mx_size") / 2 < F.col("_mx_target") - F.col("_mx_full") * F.col("_mx_total")
    copies = (F.col("_mx_full") + F.when(once_more, 1).otherwise(0)).cast("long")
    return placed.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("_mx_size").alias("size"),
        F.col("_mx_total").alias("source_size"),
        F.col("_mx_target").alias("target"),
        (copies * F.col("_mx_size")).alias("taken"),
        copies.alias("copies"),
    )


def targets(totals: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """A row for each source: its size, target and number of full epochs.

    Water filling: in order of cap / weight, a source is at its cap if its share
    of what the earlier ones leave reaches the cap; all others share the rest by
    weight.  One window over a row per source.
    """
    sources = totals.groupBy("_mx_null", "_mx_source").agg(F.sum("_mx_sum").alias("_mx_total"))
    turn = F.row_number().over(Window.orderBy("_mx_null", "_mx_source"))
    cycle = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    every = Window.partitionBy()
    low_first = Window.orderBy((F.col("cap") / F.col("w")), "_mx_null", "_mx_source")
    earlier, later = low_first.rowsBetween(Window.unboundedPreceding, -1), low_first.rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("w", F.element_at(cycle, ((turn - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("_mx_total") * max_epochs)
    shares = ranked.withColumn("left", F.sum("_mx_total").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).withColumn("w_left", F.sum("w").over(later))
    capped = shares.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    rest = F.sum("_mx_total").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    w_rest = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * rest).cast("double") / w_rest.cast("double"))
    out = capped.withColumn("_mx_target", target)
    epochs = F.when(F.col("_mx_total") > 0, F.least(F.floor(F.col("_mx_target") / F.col("_mx_total")), F.lit(max_epochs))).otherwise(0).cast("long")
    return out.select("_mx_null", "_mx_source", "_mx_total", "_mx_target", epochs.alias("_mx_full"))


def take(mixed: DataFrame) -> DataFrame:
    """Each row as many times as it is taken, without the added columns."""
    return mixed.filter("copies > 0").withColumn("_mx_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_mx_i", *ADDED)


MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as k
  from documents),
s as (select source, sum(size)::bigint as total from d group by source),
r as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w, total * 3 as cap from s),
a as (select *, (sum(total) over ())::bigint - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
             (sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following))::bigint as w_rest from r),
c as (select *, cap * w_rest <= rest * w as capped from a),
t as (select *, (sum(total) over ())::bigint - coalesce(sum(case when capped then cap end) over (), 0)::bigint as open_size,
             (sum(case when not capped then w end) over ())::bigint as open_w from c),
u as (select source, total, case when capped then cap::double else (w * open_size)::double / open_w::double end as target from t),
v as (select *, case when total > 0 then least(floor(target / total), 3) else 0 end::bigint as epochs from u),
p as (select d.*, v.total, v.target, v.epochs, coalesce(sum(size) over (partition by d.source order by k rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join v on d.source is not distinct from v.source)
select doc_id, size, total as source_size, target,
       size * (epochs + case when before + size / 2 < target - epochs * total then 1 else 0 end)::bigint as taken
from p
"""
