"""Mixing and line dedup: small cases, odd rows, and plans without Python."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import linededup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_source(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source, []).append(r)
    return out


def test_mix_meets_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), f"s{k % 3}") for k in range(600)]
    got = by_source(mixing.mix(docs(spark, rows)))
    total = sum(r.size for v in got.values() for r in v)
    for name, weight in (("s0", 5), ("s1", 2), ("s2", 1)):
        own = got[name]
        assert own[0].target == pytest.approx(total * weight / 8)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
        assert all(r.taken in (r.size * int(r.target // r.source_size), r.size * int(r.target // r.source_size + 1)) for r in own)


def test_small_sources_stop_at_three_times(spark):
    rows = [(1, "a b", "a")] + [(k, "w " * 10, "b") for k in range(2, 42)]
    got = by_source(mixing.mix(docs(spark, rows)))
    assert got["a"][0].target == 6 and got["a"][0].taken == 6
    assert got["b"][0].target == 396


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (None, "a b", None), (3, "a b", "x"), (3, "a b", "x"), (4, "\t\x0b \n", "y")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 6
    assert all(r.target == 0 for r in got if r.source == "y")
    assert mixing.mix(docs(spark, [])).collect() == []
    clash = docs(spark, rows).withColumnRenamed("lang", "target")
    assert mixing.mix(clash).columns.count("target") == 1


def test_take_repeats_rows(spark):
    rows = [(1, "a b", "a")] + [(k, "w " * 10, "b") for k in range(2, 42)]
    taken = mixing.take(mixing.mix(docs(spark, rows)))
    assert taken.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in taken.collect()).count(1) == 3


def test_mix_reruns_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    read = lambda d: sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect())
    assert read(df) == read(df.repartition(7))


def brute_lines(rows, least=4):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                sites.setdefault(line, set()).add(s)
    bad = {x for x, v in sites.items() if len(v) >= least}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)) for i, t, _ in rows]


def test_lines(spark):
    rows = [(k, f"own {k}\nseen by {k % 2}\nevery site\n\nevery site", f"s{k}") for k in range(6)]
    rows += [(10, None, "s1"), (11, "", None), (12, "three sites", None), (13, "three sites", "a"), (14, "three sites", "b"), (15, "three sites\n ", "b"), (15, "every site", "q"), (None, "every site\nx", None), (16, "\n\n", "s0")]
    df = linededup.dedup_lines(docs(spark, rows))
    got = sorted(((r.doc_id, r.clean_text) for r in df.collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)
    assert linededup.dedup_lines(docs(spark, [])).collect() == []


def test_very_long_texts_of_boilerplate(spark):
    lines = [f"line {k} of many" for k in range(60_000)]
    rows = [(k, "\n".join(lines[:: 1 + (k == 3)]) + f"\nown {k}", f"s{k}") for k in range(4)]
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_text) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    rest = "\n".join(lines[1::2])
    assert got == {**{k: (60_001, 30_000, f"{rest}\nown {k}") for k in range(3)}, 3: (30_001, 30_000, "own 3")}


def test_clashing_names_and_ties(spark):
    df = docs(spark, [(k, f"every site\nown {k}\nevery site", f"s{k}") for k in range(4)]).withColumnRenamed("lang", "clean_text").withColumn("line", F.lit(1)).withColumn("row", F.lit("x")).withColumn("site", F.lit(None).cast("int"))
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "line", "row", "site", "n_lines", "n_removed", "clean_text"]
    assert {r.doc_id: (r.n_removed, r.clean_text, r.line, r.row) for r in out.collect()} == {k: (2, f"own {k}", 1, "x") for k in range(4)}


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(k, "edge line", f"s{k}") for k in range(200)] + [(900, "below", f"t{k}") for k in range(199)]
    got = linededup.dedup_lines(docs(spark, rows), min_sites=200, lg_k=4, slack=1.0)
    assert {r.doc_id: r.clean_text for r in got.collect()} == {**{k: "" for k in range(200)}, 900: "below"}


def test_mix_splits_a_source_into_ranges(spark):
    rows = [(k, "w " * (1 + k % 5), f"s{k % 2}") for k in range(500)]
    read = lambda **how: sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(docs(spark, rows), **how).collect())
    assert read() == read(range_words=20) == read(carry=["doc_id"], range_words=3)
    long = mixing.mix(docs(spark, [(1, "w " * 700_000, "a"), (2, "w", "a"), (3, "w w", "b")])).collect()
    assert {r.doc_id: r.size for r in long} == {1: 700_000, 2: 1, 3: 2} and all(r.taken <= 3 * r.size for r in long)


def test_no_python_in_plans(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for out in (mixing.mix(df), linededup.dedup_lines(df)):
        assert not any(x in plan(out) for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op3_line_dedup", "op5_chat_formatting", "op7_decontamination", "op8_mixing", "op10_quality_rules"])
def test_against_sql(spark, sf, name):
    from millrace.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, sf).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def test_lm_counts_and_base_against_sql(spark, sf):
    """What SQL can express of op1: tokens, known ones, training tokens and the base."""
    from millrace.llm import queries

    got = {r.doc_id: r for r in queries.queries()["op1_lm_scoring"](spark, sf).collect()}
    held = {r.doc_id: r.h for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", queries.held_out(7, 2).alias("h")).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    con.sql("create table held as select unnest(?) as doc_id, unnest(?) as h", params=[list(held), list(held.values())])
    rows = con.execute(r"""
with t as (select doc_id, h, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) as token
           from documents join held using (doc_id)),
c as (select token, count(*) as c from t where not h group by token),
n as (select sum(c) as n, count(*) as v from c)
select doc_id, any_value(h), count(*), count(c.c), any_value(n.n)::bigint, sum(log10((coalesce(c.c, 0) + 1) / (n.n + v + 1))) as base from t left join c using (token), n group by doc_id""").fetchall()
    assert len(rows) == len(got)
    for i, h, tokens, known, n, base in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n) and r.base_score == pytest.approx(base, rel=1e-9)
