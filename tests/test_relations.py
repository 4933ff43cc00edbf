"""Micro-cases, cross-strategy equivalence, a dict model and plan assertions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.model import AccessPath, Family, JoinSpec, Layout, Relation, Strategy
from millrace.operators import counts, index, joins, upsert
from millrace.plans import planner

R = [(1, 10), (2, 10), (3, 20), (4, 30), (1, 20), (5, 40)]
S = [(101, 10), (102, 10), (103, 40), (104, 50), (103, 30), (105, 20), (106, 20)]
ARRIVALS = "pk long, sk long, seq long, payload string"


def relation(spark, rows):
    return Relation(spark.createDataFrame([(p, s, k, f"p{k}") for k, (p, s) in enumerate(rows)], ARRIVALS))


def pairs(df):
    return sorted((r.sk, r.pk) for r in df.collect())


@pytest.fixture(scope="module")
def micro(spark):
    return relation(spark, R), relation(spark, S)


@pytest.mark.parametrize("strategy", list(Strategy))
def test_families(micro, strategy):
    r, s = micro
    assert joins.rows(JoinSpec(r, s, strategy)).count() == 7
    assert joins.rows(JoinSpec(r, s, strategy, Family.PRIMARY)).count() == 5
    assert counts.count_matches(JoinSpec(r, s, strategy)).first().matches == 7
    assert counts.count_matches(JoinSpec(r, s, strategy, Family.PRIMARY)).first().matches == 5


@pytest.mark.parametrize("layout", list(Layout))
@pytest.mark.parametrize("covering", [False, True])
def test_every_path_gives_the_same_rows(micro, layout, covering):
    r, s = micro
    path = AccessPath(layout, covering, covering)
    assert joins.index_probe(r, s, layout, covering).count() == 7
    for other in (AccessPath(), AccessPath(Layout.LAZY), AccessPath(Layout.EAGER, True, True)):
        assert sum(x.matches for x in joins.index_merge(r, s, path, other).collect()) == 7
        assert sum(x.matches for x in joins.index_merge(r, s, other, path).collect()) == 7


def test_lists_and_stale_postings(micro):
    _, s = micro
    lazy = index.build(s, Layout.LAZY)
    eager = index.build(s, Layout.EAGER)
    read = lambda i: {r.sk: [p.pk for p in r.postings] for r in i.df.collect()}
    assert read(index.build(s, Layout.LAZY, True)) == {10: [101, 102], 20: [105, 106], 30: [103], 50: [104]}
    assert read(lazy)[20] == [105, 106] and read(eager)[20] == [106, 105]
    assert all(v == read(eager)[k][::-1] for k, v in read(lazy).items())
    assert pairs(lazy.stale()) == pairs(eager.stale()) == [(40, 103)]
    assert pairs(lazy.valid()) == pairs(index.build(s, Layout.COMPOSITE, True).postings())
    assert pairs(lazy.probe(40)) == [] and pairs(lazy.probe(10, 20)) == [(10, 101), (10, 102), (20, 105), (20, 106)]


def test_long_lists_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 3)
    rows = [(k, 1) for k in range(8)]
    got = index.build(relation(spark, rows), Layout.EAGER, True).df.orderBy("segment").collect()
    assert [[p.pk for p in r.postings] for r in got] == [[7, 6, 5], [4, 3, 2], [1, 0]]


@pytest.mark.parametrize(
    "arrivals, expected",
    [
        ([(1, 1), (2, 1), (1, 2)], [(1, 2), (2, 1)]),
        ([(1, 1), (8, 26), (2, 1), (1, 2)], [(1, 2), (2, 1), (26, 8)]),
        ([(9, 1), (7, 26), (6, 26), (1, 1), (2, 1), (1, 2)], [(1, 2), (1, 9), (2, 1), (26, 6), (26, 7)]),
    ],
)
def test_index_follows_updates(spark, arrivals, expected):
    rel = relation(spark, arrivals)
    for layout in Layout:
        assert pairs(index.build(rel, layout, True).postings()) == expected
        assert pairs(index.build(rel, layout, purged=True).postings()) == expected
        assert pairs(index.build(rel, layout).valid()) == expected


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), max_size=25), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), max_size=25))
def test_against_a_dict(spark, left, right):
    r, s = relation(spark, left), relation(spark, right)
    now_r, now_s = dict(left), dict(right)
    both = sum(a == b for a in now_r.values() for b in now_s.values())
    keys = {b for _, b in right}
    assert counts.count_matches(JoinSpec(r, s)).first().matches == both
    assert counts.count_matches(JoinSpec(r, s, family=Family.PRIMARY)).first().matches == sum(a in keys for a in now_r.values())
    assert pairs(upsert.latest(r)) == pairs(upsert.latest_by_rank(r)) == sorted((v, k) for k, v in now_r.items())
    shuffled = Relation(r.df.repartition(3, "sk"))
    assert pairs(upsert.latest(shuffled)) == pairs(upsert.latest(r))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf, tmp_path):
    from millrace.sources import tables

    r, s = tables.orders(spark, sf), tables.events(spark, sf)
    for strategy, node in ((Strategy.BROADCAST, "BroadcastHashJoin"), (Strategy.SHUFFLE_HASH, "ShuffledHashJoin"), (Strategy.SORT_MERGE, "SortMergeJoin")):
        assert node in plan(joins.rows(JoinSpec(r, s, strategy)))
        assert node in plan(joins.rows(JoinSpec(r, s, strategy, Family.PRIMARY)))
    scan = plan(counts.count_product(JoinSpec(r, s)))
    assert "ReadSchema: struct<o_custkey:bigint>" in scan and "ReadSchema: struct<user_id:bigint>" in scan
    index.save_bucketed(index.build(s, Layout.COMPOSITE, purged=True).df, "bucketed_events", 4)
    index.save_bucketed(index.build(r, Layout.COMPOSITE, purged=True).df, "bucketed_orders", 4)
    merged = spark.table("bucketed_orders").join(spark.table("bucketed_events").hint("merge"), "sk")
    assert "Exchange" not in plan(merged) and merged.count() == 8931


def test_a_large_side_is_not_broadcast(spark, sf, monkeypatch):
    from millrace.sources import tables

    r, s = tables.orders(spark, sf), tables.events(spark, sf)
    assert planner.choose(JoinSpec(r, s)).strategy is Strategy.BROADCAST
    for module in (joins, planner):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 10)
    assert "ShuffledHashJoin" in plan(joins.rows(JoinSpec(r, s, Strategy.BROADCAST)))
    assert planner.choose(JoinSpec(r, s)).strategy is Strategy.AUTO
    paths = {"left_path": AccessPath(Layout.COMPOSITE), "right_path": AccessPath(Layout.LAZY)}
    assert planner.choose(JoinSpec(r, s, **paths)).strategy is Strategy.SORT_MERGE


@pytest.fixture(scope="module")
def updates(spark):
    rng = random.Random(3)
    return relation(spark, [(rng.randrange(60), rng.randrange(12)) for _ in range(300)])


@pytest.mark.parametrize("layout", list(Layout))
@pytest.mark.parametrize("covering", [False, True])
def test_stored_indexes(spark, updates, micro, layout, covering):
    path = AccessPath(layout, covering, covering)
    kept = index.store(updates, path, buckets=4)
    assert list(kept.indexes) == [path] and index.access(kept, AccessPath(layout, covering)) is kept.indexes[path]
    assert pairs(index.access(kept, path).valid()) == pairs(upsert.latest(updates))
    for left in (updates, micro[0]):
        assert sorted(map(tuple, joins.index_probe(left, kept, layout, covering).collect())) == sorted(map(tuple, joins.rows(JoinSpec(left, updates)).collect()))
    merged = joins.index_merge(kept, kept, path, path)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, counts.count_product(JoinSpec(updates, updates)).select(*merged.columns).collect()))


def test_stored_indexes_are_read_without_an_exchange(spark, updates):
    path = AccessPath(Layout.EAGER, True, True)
    kept = index.store(updates, path, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = joins.index_merge(kept, kept, path, path)
        assert "Exchange" not in plan(merged) and "Window" not in plan(merged)
        probe = joins.index_probe(updates, kept, Layout.EAGER, True)
        probe.collect()
        below = plan(probe)
        assert "Bucketed: true" in below and "payload" not in below.split("Scan parquet")[1].split("ReadSchema")[0].split("Output")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_the_columns_asked_for_are_read(spark, tmp_path):
    spark.createDataFrame([(k % 5, k % 3, k, "x" * 50) for k in range(40)], ARRIVALS).write.parquet(str(tmp_path / "wide"))
    rel = Relation(spark.read.parquet(str(tmp_path / "wide")))
    for df in (joins.index_probe(rel, rel, Layout.COMPOSITE, False), joins.rows(JoinSpec(rel, rel)), joins.index_merge(rel, rel, AccessPath(), AccessPath(Layout.COMPOSITE))):
        assert "payload" not in plan(df)


def test_lists_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 7)
    rng = random.Random(9)
    rows = [(k, 0 if rng.random() < 0.6 else rng.randrange(1, 9)) for k in range(200)]
    for broadcast in (1_000_000, 0):
        monkeypatch.setattr(index, "BROADCAST_KEYS", broadcast)
        for layout in (Layout.LAZY, Layout.EAGER):
            got = {(r.sk, r.segment): [p.pk for p in r.postings] for r in index.build(relation(spark, rows), layout).df.collect()}
            for sk in range(9):
                own = [p for p, s in rows if s == sk][:: 1 if layout is Layout.LAZY else -1]
                assert [got.get((sk, k)) for k in range(-(-len(own) // 7))] == [own[k : k + 7] for k in range(0, len(own), 7)]


def test_counters(spark):
    row = index.counters(relation(spark, [(1, 5), (2, 5), (1, 6), (1, 7)])).first()
    assert tuple(row) == (4, 4, 2)
    assert tuple(index.counters(relation(spark, [(1, 1)]).__class__(relation(spark, [(1, 1)]).df.limit(0))).first()) == (0, 0, 0)


def test_access_path_names():
    assert planner.access_path("coveringEager") == AccessPath(Layout.EAGER, True, True)
    assert planner.access_path("Reg") == AccessPath()
    for bad in ("hash", "coveringReg", ""):
        with pytest.raises(planner.UnsupportedAccessPath):
            planner.access_path(bad)


def test_covering_needs_purging(micro):
    with pytest.raises(ValueError):
        index.build(micro[0], Layout.LAZY, covering=True, purged=False)


@pytest.mark.parametrize("compact", [2, 20])
def test_streaming_equals_batch(spark, tmp_path, compact):
    from millrace.streaming import upserts

    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.randrange(5), k, "x") for k in range(140)]
    for k in range(7):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = upserts.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), compact)
    query.awaitTermination()
    assert query.exception() is None
    got = upserts.read_version(spark, str(tmp_path / "out"), 6, compact)
    want = pairs(upsert.latest(Relation(spark.createDataFrame(rows, ARRIVALS))))
    assert pairs(got) == want
    left = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert ("whole=5" in left) == (compact == 2) and ("batch=0" in left) == (compact == 20) and "whole=1" not in left
    upserts.upsert_into(str(tmp_path / "out"), compact)(spark.read.schema(ARRIVALS).parquet(str(tmp_path / "out" / "batch=6")), 7)  # a batch that runs again changes nothing
    assert pairs(upserts.read_version(spark, str(tmp_path / "out"), 7, compact)) == want
