"""Line dedup by cross-site spread: HyperLogLog sketches, exact counts near the threshold.

A line that many sites carry is boilerplate and leaves every document.  DataFrame
operations only:

1. texts are split and their lines hashed once; a table keeps each row's key, its site
   and its lines as 64-bit hashes, and all that follows reads that table;
2. one aggregation merges a HyperLogLog sketch of sites for each line, within the map
   tasks first, so a very common line shuffles a sketch a task;
3. a line whose estimate is clear of ``min_sites`` by more than ``slack`` is
   decided by it; for the lines in between distinct sites are counted exactly;
4. each document's boilerplate lines are gathered as positions, and what stands between
   them is its clean text, in time linear in its lines; the text is exchanged once and
   lines never are.  A very common line meets the boilerplate set over salted keys.

Defined results: a null text stays null and an empty one empty; lines without a
word are never counted or removed; a null site is one more site; repeats of a line
in one document count once and are all removed; a line of exactly ``min_sites`` sites is
boilerplate; equal rows give equal results; a very long text is one row of as many hashes
as it has lines; an empty table gives an empty table; input columns called like an
added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._session import checkpointed
from millrace.llm.components import salted_join

ADDED = ("n_lines", "n_removed", "clean_text")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c")) != ""


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """row, site and the lines' hashes (null: without a word) of every text, as a table."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`")), F.lit(""))
    hashes = F.transform(_lines(F.col(f"`{text_col}`")), lambda x: F.when(_has_word(x), F.xxhash64(x)))
    return checkpointed(docs.filter(F.col(f"`{text_col}`").isNotNull()).select(_row_key(id_col, text_col).alias("row"), site.alias("site"), hashes.alias("lines")))


def boilerplate(hashed: DataFrame, min_sites: int = 4, lg_k: int = 10, slack: float = 0.15) -> DataFrame:
    """Hashes (``line``) of the lines that ``min_sites`` or more sites carry."""
    lines = hashed.select(F.explode(F.array_distinct("lines")).alias("line"), "site").filter(F.col("line").isNotNull())
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).filter(F.col("sites") >= min_sites * (1 - slack))
    near = spread.filter(F.col("sites") <= min_sites * (1 + slack)).select("line")
    exact = salted_join(lines, near, ["line"], "site", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(F.col("sites") > min_sites * (1 + slack)).select("line").unionAll(exact.select("line"))


def dedup_lines(docs: DataFrame, min_sites: int = 4, lg_k: int = 10, slack: float = 0.15, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with n_lines, n_removed and clean_text."""
    kept = [c for c in docs.columns if c not in ADDED]
    hashed = hashed_lines(docs, id_col, text_col, site_col)
    bad = boilerplate(hashed, min_sites, lg_k, slack)
    places = hashed.select("row", F.posexplode("lines").alias("at", "line")).filter(F.col("line").isNotNull())
    gone = salted_join(places, bad, ["line"], "row").groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("_ld_gone"))
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), _row_key(id_col, text_col).alias("_ld_row")).join(gone.withColumnRenamed("row", "_ld_row"), "_ld_row", "left")
    # the split is used twice below, so it is computed once and not within the lambda
    out = rows.withColumn("_ld_lines", _lines(F.col(f"`{text_col}`")))
    ends = F.concat(F.col("_ld_gone"), F.array(F.size("_ld_lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("_ld_gone", lambda at: at + 1))
    stays = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice(F.col("_ld_lines"), x["a"] + 1, x["b"] - x["a"])))
    return out.select(
        *(F.col(f"`{c}`") for c in kept),
        F.coalesce(F.size("_ld_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_ld_gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(stays, "\n")).alias("clean_text"),
    )


DEDUP_SQL = r"""
with l as (
  select doc_id, text, coalesce('s' || source, '') as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
bad as (select line from l where trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' group by line having count(distinct site) >= 4),
k as (
  select doc_id, text, count(*) as n_lines, count(bad.line) as n_removed, string_agg(l.line, chr(10) order by pos) filter (where bad.line is null) as clean
  from l left join bad on l.line = bad.line group by doc_id, text)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       case when d.text is null then null else coalesce(k.clean, '') end as clean_text
from documents d left join k on d.doc_id = k.doc_id and d.text = k.text
"""
