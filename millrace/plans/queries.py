"""Registered queries over the star-schema tables, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import generators, keys
from millrace.model import AccessPath, Family, JoinSpec, Layout, Relation, Strategy
from millrace.operators import counts, index, joins, sorts, upsert
from millrace.plans import grid, planner
from millrace.sources import tables, u64
from millrace.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SOURCES = """
with r_ord as (select o_orderkey as pk, o_custkey as sk, o_orderkey as seq from orders),
s_evt as (select event_id as pk, user_id as sk, event_id as seq from events),
li_raw as (select l_orderkey * 10 + l_linenumber as pk, l_partkey as sk, l_suppkey::varchar as payload,
                  row_number() over (order by l_shipdate, l_partkey, l_suppkey, l_orderkey, l_linenumber) as seq from lineitem),
li as (select pk, sk, payload, seq from (select *, row_number() over (partition by pk order by seq desc) as n from li_raw) where n = 1),
p_small as (select p_partkey as pk, p_partkey as sk, p_partkey as seq from part where p_size <= 10)
"""


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = _SOURCES + sql


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_product(JoinSpec(tables.orders(spark, sf_dir), tables.events(spark, sf_dir)))


_STORED: dict[tuple[str, str, str], Relation] = {}


def stored(spark: SparkSession, d: str, name: str, *paths: AccessPath) -> Relation:
    """A relation with indexes that are built once for a session and a folder, then read."""
    key = (spark.sparkContext.applicationId, d, name)
    rel = _STORED.get(key) or getattr(tables, name)(spark, d)
    for path in paths:
        if path.layout is not None and path not in rel.indexes:
            rel = index.store(rel, path)
    _STORED[key] = rel
    return rel


# Joins of both families

_NP = "select sk, r.pk as r_pk, s.pk as s_pk from r_ord r join s_evt s using (sk)"
_P = "select sk, pk as r_pk from r_ord where sk in (select sk from s_evt)"


def _join(strategy: Strategy, family: Family, **paths) -> Query:
    return lambda spark, d: joins.rows(planner.choose(JoinSpec(tables.orders(spark, d), tables.events(spark, d), strategy, family, **paths)))


for _name, _how in (("broadcast", Strategy.BROADCAST), ("shuffle_hash", Strategy.SHUFFLE_HASH), ("sort_merge", Strategy.SORT_MERGE), ("auto", Strategy.AUTO)):
    add(f"np_{_name}", _join(_how, Family.SECONDARY), _NP)
for _name, _how in (("nested_loop", Strategy.BROADCAST), ("shuffle_hash", Strategy.SHUFFLE_HASH), ("sort_merge", Strategy.SORT_MERGE)):
    add(f"p_{_name}", _join(_how, Family.PRIMARY), _P)
for _layout in Layout:
    for _covering in (False, True):
        add(f"p_index_merge_{_layout.value}{'_covering' * _covering}", lambda spark, d, p=AccessPath(_layout, _covering, _covering): joins.rows(JoinSpec(stored(spark, d, "line_updates", p), tables.events(spark, d), Strategy.SORT_MERGE, Family.PRIMARY, p)), "select sk, pk as r_pk from li where sk in (select sk from s_evt)")

add("np_count_product", lambda spark, d: counts.count_product(JoinSpec(tables.orders(spark, d), tables.events(spark, d))), "select sk, n_r, n_s, n_r * n_s as matches from (select sk, count(*) as n_r from r_ord group by sk) join (select sk, count(*) as n_s from s_evt group by sk) using (sk)")
add("np_count_matches", lambda spark, d: counts.count_matches(JoinSpec(tables.orders(spark, d), tables.events(spark, d))), "select count(*) as matches from r_ord join s_evt using (sk)")
add("np_count_self", lambda spark, d: counts.count_matches(JoinSpec(tables.line_updates(spark, d), tables.line_updates(spark, d))), "select count(*) as matches from li a join li b using (sk)")
add("p_count_matches", lambda spark, d: counts.count_matches(JoinSpec(tables.line_updates(spark, d), tables.events(spark, d), family=Family.PRIMARY)), "select count(*) as matches from li where sk in (select sk from s_evt)")

# Last writer wins

_LATEST = "select pk, sk, payload from li"
add("lww_latest", lambda spark, d: upsert.latest_by_rank(tables.line_updates(spark, d)).select("pk", "sk", "payload"), _LATEST)
add("lww_latest_maxby", lambda spark, d: upsert.latest(tables.line_updates(spark, d)).select("pk", "sk", "payload"), _LATEST)
add("primary_keys", lambda spark, d: upsert.key_set(tables.line_updates(spark, d)), "select distinct sk from li_raw")
add("second_mode", lambda spark, d: upsert.latest(tables.line_updates(spark, d)).select(keys.pad(F.col("pk")).alias("key"), F.concat(keys.pad(F.col("sk")), keys.payload(11)).alias("value")), "select format('{:010d}', pk) as key, format('{:010d}', sk) || repeat('0', 11) as value from li")
add("ordered_scan", lambda spark, d: sorts.total_sort(upsert.latest(tables.line_updates(spark, d)).select("pk", "sk"), "pk"), "select pk, sk from li order by pk")
add("ordered_values", lambda spark, d: sorts.total_sort(upsert.latest(tables.line_updates(spark, d), "payload").select("pk", F.col("payload").alias("value")), "pk"), "select pk, payload as value from li order by pk")
add("point_lookup", lambda spark, d: upsert.latest(tables.line_updates(spark, d)).filter("pk = 277").select("pk", "sk", "payload"), "select pk, sk, payload from li where pk = 277")

# Secondary indexes


def _index(layout: Layout, covering: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = index.build(tables.line_updates(spark, d), layout, covering).df
        if layout is Layout.COMPOSITE:
            return df
        words = F.transform("postings", lambda p: F.concat_ws(":", p["pk"].cast("string"), p["payload"]) if covering else p["pk"].cast("string"))
        return df.select("sk", "segment", F.size("postings").cast("long").alias("n"), F.array_join(words, ",").alias("postings"))

    return query


_LISTS = """, u as ({rows}), t as (select *, row_number() over (partition by sk order by seq {way}, pk) - 1 as turn from u)
select sk, turn // 4096 as segment, count(*) as n, string_agg({word}, ',' order by turn) as postings from t group by sk, turn // 4096"""
add("ix_composite", _index(Layout.COMPOSITE, False), "select distinct sk, pk from li_raw")
add("ix_composite_covering", _index(Layout.COMPOSITE, True), "select sk, pk, payload from li")
for _layout, _way, _first in ((Layout.LAZY, "asc", "min"), (Layout.EAGER, "desc", "max")):
    add(f"ix_{_layout.value}", _index(_layout, False), _LISTS.format(rows=f"select sk, pk, {_first}(seq) as seq from li_raw group by sk, pk", way=_way, word="pk::varchar"))
    add(f"ix_{_layout.value}_covering", _index(_layout, True), _LISTS.format(rows="select * from li", way=_way, word="pk || ':' || payload"))
add("ix_purged_plain", lambda spark, d: index.build(tables.line_updates(spark, d), Layout.COMPOSITE, purged=True).df, "select sk, pk from li")
add("ix_validate", lambda spark, d: index.build(tables.line_updates(spark, d), Layout.LAZY).valid(), "select sk, pk from li")
add("ix_stale", lambda spark, d: index.build(tables.line_updates(spark, d), Layout.EAGER).stale(), "select distinct sk, pk from li_raw where (sk, pk) not in (select (sk, pk) from li)")
add("ix_counters", lambda spark, d: index.counters(tables.line_updates(spark, d)), "select count(*) as n_scanned, count(*) as n_inserted, count(*) - count(distinct pk) as n_deleted from li_raw")
add("ix_probe", lambda spark, d: index.build(tables.line_updates(spark, d), Layout.COMPOSITE).probe(7), "select sk, pk from li where sk = 7")
add("ix_probe_range", lambda spark, d: index.build(tables.line_updates(spark, d), Layout.LAZY, True).probe(10, 30), "select sk, pk, payload from li where sk between 10 and 30")

# Joins over indexes

for _layout in Layout:
    for _covering in (False, True):
        _suffix = f"{_layout.value}{'_covering' * _covering}"
        _path = AccessPath(_layout, _covering, _covering)
        add(f"inl_{_suffix}", lambda spark, d, p=_path: joins.index_probe(tables.small_parts(spark, d), stored(spark, d, "line_updates", p), p.layout, p.covering), "select sk, r.pk as r_pk, s.pk as s_pk from p_small r join li s using (sk)")
        add(f"sj_index_{_suffix}", lambda spark, d, p=_path: joins.index_merge(stored(spark, d, "line_updates", p), stored(spark, d, "line_updates", p), p, p), "select sk, n as n_r, n as n_s, n * n as matches from (select sk, count(*) as n from li group by sk)")
        add(f"sj_single_index_{_suffix}", lambda spark, d, p=_path: joins.rows(JoinSpec(tables.small_parts(spark, d), stored(spark, d, "line_updates", p), Strategy.SORT_MERGE, right_path=p)), "select sk, r.pk as r_pk, s.pk as s_pk from p_small r join li s using (sk)")
_MERGED = "select sk, n_r, n_s, n_r * n_s as matches from (select sk, count(*) as n_r from li group by sk) join (select sk, count(*) as n_s from s_evt group by sk) using (sk)"
for _a in ("reg", "comp", "coveringLazy", "eager"):
    for _b in ("lazy", "coveringEager", "coveringComp"):
        add(f"sj_mixed_{_a}_{_b}".lower(), lambda spark, d, a=planner.access_path(_a), b=planner.access_path(_b): joins.index_merge(stored(spark, d, "line_updates", a), stored(spark, d, "events", b), a, b), _MERGED)

# Partitions, sorts, counts

_HASHED = "list_reduce(list_prepend(0::bigint, list_transform(range(1, 11), lambda i: ascii(substring(format('{:010d}', sk), i, 1))::bigint)), lambda h, x: (h * 131 + x) & 4294967295)"
add("hash_partition_histogram", lambda spark, d: sorts.bucket_histogram(tables.orders(spark, d).df, "sk", 500), f"select ({_HASHED} % 500)::int as bucket, count(*) as n from r_ord group by 1")
add("group_counts", lambda spark, d: counts.group_counts(tables.line_updates(spark, d).df), "select sk, count(*) as n from li_raw group by sk")
add("avg_repetitions", lambda spark, d: counts.repetitions(tables.line_updates(spark, d).df), "select count(*) as n_rows, count(distinct sk) as n_keys, count(*) / count(distinct sk) as avg_repetitions from li_raw")
add("total_sort_rank", lambda spark, d: sorts.ranked(upsert.latest(tables.line_updates(spark, d)).select("sk", "pk"), "sk", "pk"), "select sk, pk, row_number() over (order by sk, pk) as rank from li")
add("first_n", lambda spark, d: sorts.first_n(tables.events(spark, d).df, 500), "select pk, sk, seq from s_evt where seq < 500")
add("run_lengths", lambda spark, d: counts.group_counts(sorts.hash_partitioned(upsert.latest(tables.line_updates(spark, d)).select("sk"), 16), "run"), "select sk, count(*) as run from li group by sk")

# Scalar functions


def _key_functions(spark: SparkSession, d: str) -> DataFrame:
    sk, pk = F.col("sk"), F.col("pk")
    composite = keys.compose(sk, pk)
    return tables.orders(spark, d).df.select("pk", keys.pad(sk).alias("padded"), keys.pad_truncated(sk * 123456789).alias("cut"), composite.alias("composite"), keys.first_part(composite).alias("first"), keys.second_part(composite).alias("second"), keys.string_hash(keys.pad(sk)).alias("hash"))


add("key_encode", _key_functions, f"""select pk, format('{{:010d}}', sk) as padded, lpad((sk * 123456789)::varchar, 10, '0') as cut, format('{{:010d}}', sk) || format('{{:010d}}', pk) as composite,
  format('{{:010d}}', sk) as first, format('{{:010d}}', pk) as second, {_HASHED} as hash from r_ord""")
add("chunk_set", lambda spark, d: tables.orders(spark, d).df.select("pk", F.array_join(F.array_sort(keys.chunks(keys.compose(F.col("sk"), F.col("pk")), 3)), "|").alias("pieces")), "select pk, array_to_string(list_sort(list_distinct(regexp_extract_all(format('{:010d}', sk) || format('{:010d}', pk), '.{1,3}'))), '|') as pieces from r_ord")
add("line_fields", lambda spark, d: tables.orders(spark, d).df.select("pk", keys.fields(keys.trim_newline(F.concat_ws(",", F.col("sk").cast("string"), F.concat(F.col("pk").cast("string"), F.lit("\n"))))).alias("f")).select("pk", F.col("f")[0].alias("a"), F.col("f")[1].alias("b")), "select pk, sk::varchar as a, pk::varchar as b from r_ord")
add("short_lines", lambda spark, d: tables.orders(spark, d).df.select("pk", keys.fields(F.when(F.col("pk") % 3 == 0, F.col("sk").cast("string")).otherwise(F.concat_ws(",", "sk", "pk"))).alias("f")).select("pk", F.col("f").isNull().alias("dropped"), F.size("f").alias("n")), "select pk, pk % 3 = 0 as dropped, case when pk % 3 = 0 then null else 2 end as n from r_ord")
add("missing_digits", lambda spark, d: tables.orders(spark, d).df.select("pk", keys.missing_digits_of_power(F.col("sk").cast("long"), 4).alias("n")), "select pk, 10 - least(10, length((sk * sk * sk * sk)::varchar)) as n from r_ord")
add("little_endian", lambda spark, d: tables.orders(spark, d).df.select("pk", F.hex(keys.to_little_endian(F.col("sk"))).alias("bytes"), keys.little_endian(keys.to_little_endian(F.col("sk"))).cast("long").alias("key")), "select pk, string_agg(substr(h, 15 - 2 * k::int, 2), '' order by k) as bytes, any_value(sk) as key from (select pk, sk, lpad(to_hex(sk), 16, '0') as h from r_ord), range(0, 8) t(k) group by pk")
add("value_sizes", lambda spark, d: spark.createDataFrame([(e, grid.value_size(e)) for e in grid.ENTRY_SIZES], "entry long, value long"), "select e as entry, ceil(0.95 * e - 10)::bigint as value from (values (32::bigint), (128), (512), (1024), (2048)) t(e)")
add("drop_posting", lambda spark, d: index.build(tables.events(spark, d), Layout.LAZY, purged=True).df.select("sk", "segment", F.array_join(F.transform(keys.without(F.col("postings"), F.lit(5)), lambda p: p["pk"].cast("string")), ",").alias("postings")), "select sk, 0::bigint as segment, coalesce(string_agg(pk::varchar, ',' order by seq) filter (where pk <> 5), '') as postings from s_evt group by sk")

# Generators and files

_ZIPF_N, _ZIPF_THETA = 1000, 0.5


def _zipf(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.events(spark, d).df
    total = rows.count()
    value = generators.zipf_value((F.col("pk") + 0.5) / total, generators.zipf(spark, _ZIPF_N, _ZIPF_THETA))
    return rows.select((value / 50).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


add("zipf_transform", _zipf, """, z as (select sum(pow(i, -0.5)) as zn from range(1, 1001) t(i)),
c as (select zn, 2.0::double as alpha, (1 - pow(2 / 1000::double, 0.5)) / (1 - (1 + pow(0.5, 0.5)) / zn) as eta from z),
u as (select (pk + 0.5::double) / (select count(*) from s_evt) as u from s_evt),
v as (select case when u * zn < 1 then 0 when u * zn < 1 + pow(0.5, 0.5) then 1 else floor(1000 * pow(eta * u - eta + 1, alpha)) end::bigint as v from u, c)
select v // 50 as bucket, count(*) as n from v group by 1""")
add("harmonic", lambda spark, d: spark.range(1).select(F.round(F.lit(generators.zeta(spark, 1000, 0.7)), 6).alias("zeta")), "select round(sum(pow(i, -0.7)), 6) as zeta from range(1, 1001) t(i)")


def _pair_sizes(made: tuple[DataFrame, DataFrame]) -> DataFrame:
    left, right = counts.group_counts(made[0], "n_r"), counts.group_counts(made[1], "n_s")
    return left.join(right, "sk", "full_outer").select("sk", F.coalesce("n_r", F.lit(0)).alias("n_r"), F.coalesce("n_s", F.lit(0)).alias("n_s"))


def _draw(seed: int, number: str = "i") -> str:
    return f"(('0x' || substr(md5('{seed}|' || ({number})::varchar), 1, 13))::bigint / 4503599627370496.0::double)"


def _key(seed: int, digits: int = 10, number: str = "i") -> str:
    return f"floor({_draw(seed, number)} * {10**digits}.0::double)::bigint"


def _zipf_sql(n: int, u: str) -> str:
    """Zipf keys of exponent 0.5 as z(i, sk) below n, of the draws ``u``."""
    return f"""zn as (select sum(pow(i, -0.5)) as zn from range(1, {n + 1}) t(i)),
ze as (select zn, (1 - pow(2 / {n}::double, 0.5)) / (1 - (1 + pow(0.5, 0.5)) / zn) as eta from zn),
z as (select i, case when u * zn < 1 then 0 when u * zn < 1 + pow(0.5, 0.5) then 1 else floor({n} * pow(eta * u - eta + 1, 2.0)) end::bigint as sk
      from (select i, {u} as u from range({n}) t(i)), ze)"""


_BOTH = """select sk, coalesce(n_r, 0) as n_r, coalesce(n_s, 0) as n_s from (select sk, count(*) as n_r from l group by sk) full join (select sk, count(*) as n_s from rr group by sk) using (sk)"""
add("gen_uniform_pair", lambda spark, d: _pair_sizes(generators.uniform_pair(spark, 10_000, 10_000)), f""", rr as (select i, {_key(42)} as sk, {_draw(43)} > 0.2::double as shared from range(10000) t(i)),
l as (select sk from rr where shared union all select {_key(44)} from range(10000) t(i) where i < 10000 - (select count(*) from rr where shared)) {_BOTH}""")
add("gen_zipf_pair", lambda spark, d: _pair_sizes(generators.zipf_pair(spark, 12_000, 10_000, 0.5)), f""", {_zipf_sql(10_000, _draw(42))},
l as (select sk from z union all select floor(abs(sqrt(-2.0::double * ln(1 - {_draw(43)})) * cos(2 * pi() * {_draw(1043)})) * 0.5::double)::bigint from range(2000) t(i)),
rr as (select sk from z) {_BOTH}""")
add("gen_keys", lambda spark, d: spark.range(1_000).select("id", generators.uniform_key(5).alias("key")), f"select i as id, {_key(5)} as key from range(1000) t(i)")
add("gen_fixed_digits", lambda spark, d: spark.range(1_000).select("id", generators.fixed_digits_key(7, 6).alias("key")), f"select i as id, floor({_draw(7)} * 900000.0::double)::bigint + 100000 as key from range(1000) t(i)")
add("gen_shuffled", lambda spark, d: generators.shuffled(tables.events(spark, d).df.select("pk", "sk"), 9, "pk"), "select pk, sk, row_number() over (order by md5('9|' || pk::varchar), pk) - 1 as seq from s_evt")
add("gen_included", lambda spark, d: tables.events(spark, d).df.filter(generators.draw(11, "pk") > 0.2).select("pk"), f"select pk from s_evt where {_draw(11, 'pk')} > 0.2::double")

# The experiment grid, at small size: every operator finds the same matches

_GRID_TUPLES = 1_000
add("grid_matches", lambda spark, d: grid.metrics(spark, _GRID_TUPLES, [p for p in grid.points() if p.name in ("entry 128", "skew 0.5")]).select("point", "operator", "matches"), f""", {_zipf_sql(_GRID_TUPLES, _draw(42))},
u as (select i, {_key(42, 3)} as sk, {_draw(43)} > 0.2::double as shared from range({_GRID_TUPLES}) t(i)),
lu as (select i, sk from u where shared union all select -i - 1, {_key(44, 3)} from range({_GRID_TUPLES}) t(i) where i < {_GRID_TUPLES} - (select count(*) from u where shared)),
a as (select 'entry 128' as point, 0 as side, sk, row_number() over (order by md5('45|' || i::varchar || '|1'), i) - 1 as seq from lu
      union all select 'entry 128', 1, sk, row_number() over (order by md5('46|' || i::varchar || '|1'), i) - 1 from u
      union all select 'skew 0.5', 0, sk, row_number() over (order by md5('44|' || i::varchar), i) - 1 from z
      union all select 'skew 0.5', 1, sk, row_number() over (order by md5('45|' || i::varchar), i) - 1 from z),
k as (select point, side, sk, seq, case side when 0 then {_key(52, 10, "seq")} else {_key(53, 10, "seq")} end as pk from a),
now as (select point, side, pk, arg_max(sk, seq) as sk from k group by point, side, pk),
m as (select r.point, false as prim, count(*) as matches from now r join now s on r.point = s.point and r.sk = s.sk and r.side = 0 and s.side = 1 group by r.point
      union all select point, true, count(*) from now r where side = 0 and (point, sk) in (select (point, sk) from k where side = 1) group by point)
select point, operator, matches from m, (values {", ".join(f"('{name}', {'true' if 'primary' in name else 'false'})" for name in grid.operators())}) o(operator, is_primary) where prim = is_primary""")


def _u64_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "keys")
    ordered = sorts.total_sort(tables.orders(spark, d).df, "seq")
    u64.write_keys(ordered, folder)
    return u64.read_keys(spark, folder)


add("u64_scan", _u64_round_trip, "select row_number() over (order by seq) - 1 as seq, sk from r_ord")
add("storage_files", lambda spark, d: tables.storage_files(tables.table(spark, d, "orders")).agg(F.sum("n_rows").cast("long").alias("n_rows"), F.count("*").alias("n_files"), (F.min("n_bytes") > 0).alias("has_bytes")), "select count(*) as n_rows, 1::bigint as n_files, true as has_bytes from r_ord")
