import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import generators, keys
from millrace.operators import counts, sorts
from millrace.plans import grid
from millrace.sources import u64

HASHES = {"0000000000": (703076288, 288), "0000000001": (703076289, 289), "0000000042": (703076814, 314), "1234567890": (3166105391, 391), "9999999999": (2177080372, 372)}
ZIPF = {0.1: (556.522256, 0.999749, [0, 6, 77, 463, 889, 999]), 0.3: (179.004871, 0.997192, [0, 1, 38, 372, 860, 999]), 0.5: (61.801009, 0.982416, [0, 0, 13, 258, 813, 999]), 0.7: (23.703191, 0.906815, [0, 0, 3, 133, 728, 999])}


def test_string_hash(spark):
    df = spark.createDataFrame([(k,) for k in [*HASHES, ""]], "k string").select("k", keys.string_hash(F.col("k")).alias("h"), keys.hash_bucket(F.col("k"), 500).alias("b"))
    assert {r.k: (r.h, r.b) for r in df.collect()} == HASHES | {"": (0, 0)}


def test_encoding(spark):
    row = spark.range(1).select(
        keys.pad(F.lit(42)).alias("pad"), keys.pad(F.lit(12345678901)).alias("wide"), keys.pad_truncated(F.lit(12345678901)).alias("cut"),
        keys.first_part(keys.compose(F.lit(7), F.lit(9))).alias("a"), keys.second_part(keys.compose(F.lit(7), F.lit(9))).alias("b"),
        F.array_sort(keys.chunks(F.lit("aabbaac"), 2)).alias("chunks"), keys.trim_newline(F.lit("x \n")).alias("line"), keys.fields(F.lit("a,b")).alias("f"), keys.fields(F.lit("a")).alias("short"),
    ).first()
    assert (row.pad, row.wide, row.cut) == ("0000000042", "12345678901", "1234567890")
    assert (row.a, row.b, row.chunks, row.line, row.f, row.short) == ("0000000007", "0000000009", ["aa", "bb", "c"], "x ", ["a", "b"], None)


def test_domain(spark):
    assert keys.check_domain(spark.createDataFrame([(0,), (10**10 - 1,)], "sk long"), "sk").count() == 2
    for bad in (-1, 10**10, None):
        with pytest.raises(PySparkException):
            keys.check_domain(spark.createDataFrame([(bad,)], "sk long"), "sk").collect()


@pytest.mark.parametrize("theta", list(ZIPF))
def test_zipf(spark, theta):
    zeta, eta, values = ZIPF[theta]
    z = generators.zipf(spark, 1000, theta)
    assert z.zeta_n == pytest.approx(zeta, abs=1e-6) and z.eta == pytest.approx(eta, abs=1e-6)
    df = spark.createDataFrame([(u,) for u in (0.0001, 0.01, 0.1, 0.5, 0.9, 0.999999)], "u double")
    assert [r[0] for r in df.select(generators.zipf_value(F.col("u"), z)).collect()] == values


def test_pairs(spark):
    r, s = generators.zipf_pair(spark, 1500, 1000, 0.5)
    assert (r.count(), s.count()) == (1500, 1000)
    a, b = generators.uniform_pair(spark, 1000, 1000)
    assert b.count() == 1000 and a.count() >= 1000
    shared = a.select("sk").distinct().join(b.select("sk").distinct(), "sk").count()
    assert 700 < shared < 900
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, generators.uniform_pair(spark, 1000, 1000)[0].collect()))
    assert all(10**5 <= x[0] < 10**6 for x in spark.range(50).select(generators.fixed_digits_key(1, 6)).collect())
    with pytest.raises(ValueError):
        generators.zipf(spark, 10, 1)


def test_key_files(spark, tmp_path):
    values = [1, 42, 2**63 - 1, 2**63, 2**64 - 1]
    (tmp_path / "a").write_bytes(b"".join(v.to_bytes(8, "little") for v in values))
    got = u64.read_keys(spark, str(tmp_path / "a"), long=False).orderBy("seq").collect()
    assert [(r.seq, int(r.sk)) for r in got] == list(enumerate(values))
    assert u64.read_keys(spark, str(tmp_path / "a"), limit=3).count() == 3 and u64.read_keys(spark, str(tmp_path / "a"), limit=0).count() == 0
    assert sorted(int(r.sk) for r in u64.read_records(spark, str(tmp_path / "a")).collect()) == values
    (tmp_path / "many").mkdir()
    for name, n in (("x", 4096), ("y", 1024)):
        (tmp_path / "many" / name).write_bytes(np.arange(n, dtype="<u8").tobytes())
    assert u64._record_bytes(spark, str(tmp_path / "many")) == 8192
    assert sorted(int(r.sk) for r in u64.read_records(spark, str(tmp_path / "many")).collect()) == sorted([*range(4096), *range(1024)])
    with pytest.raises(PySparkException):
        u64.read_keys(spark, str(tmp_path / "a")).collect()
    (tmp_path / "b").write_bytes(b"123456789")
    with pytest.raises(PySparkException):
        u64.read_keys(spark, str(tmp_path / "b")).collect()


def test_key_files_keep_nothing_of_nulls(spark, tmp_path):
    df = spark.createDataFrame([(5,), (0,), (2**40,)], "sk long").coalesce(1)
    u64.write_keys(df, str(tmp_path / "k"))
    assert [r.sk for r in u64.read_keys(spark, str(tmp_path / "k")).orderBy("seq").collect()] == [5, 0, 2**40]
    assert (tmp_path / "k" / "part-000000").read_bytes() == b"".join(v.to_bytes(8, "little") for v in (5, 0, 2**40))
    with pytest.raises(PySparkException):
        u64.write_keys(spark.createDataFrame([(None,)], "sk long"), str(tmp_path / "n"))


def test_key_sources(spark, tmp_path):
    assert grid.key_source("skew_0.3", "skew_0.3") == grid.Generated(0.3) and grid.key_source("skew_", "x") == grid.Generated(0.0)
    for name, values in (("r", [1, 2, 3, 9]), ("s", [2, 3, 4])):
        (tmp_path / name).write_bytes(b"".join(v.to_bytes(8, "little") for v in values))
    source = grid.key_source(str(tmp_path / "r"), str(tmp_path / "s"))
    assert isinstance(source, grid.KeyFiles)
    point = grid.Point("files", 50, source)
    r, s = grid.relations(spark, point, 3)
    assert sorted(x.sk for x in r.df.collect()) == [1, 2, 3] and all(len(x.payload) == 40 for x in s.df.collect())
    rows = grid.metrics(spark, 3, [point]).collect()
    assert {x.matches for x in rows} == {2} and len(rows) == len(grid.operators()) and all(x.join_ms >= 0 for x in rows)


def test_arrival_order_is_dense(spark):
    df = generators.shuffled(spark.range(500).repartition(7), 4, "id")
    assert sorted(r.seq for r in df.collect()) == list(range(500))
    again = generators.shuffled(spark.range(500).repartition(3), 4, "id")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))
    assert sorts.first_n(df, 10).count() == 10


def test_rank_and_counts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("sk"), F.col("id").alias("pk"))
    assert all(r["rank"] == r.sk + 1 for r in sorts.ranked(df, "sk", "pk").collect())
    row = counts.repetitions(spark.createDataFrame([(1,), (1,), (2,)], "sk long")).first()
    assert (row.n_rows, row.n_keys, row.avg_repetitions) == (3, 2, 1.5)
    assert counts.repetitions(spark.createDataFrame([], "sk long")).first().n_rows == 0


def test_grid(spark):
    assert [p.value for p in grid.points()][:5] == [21, 112, 477, 963, 1936]
    assert len(grid.points()) * len(grid.operators()) == 108
    rows = list(grid.run(spark, 300, [grid.points()[5]]))
    assert len({r["matches"] for r in rows if "primary" in r["operator"]}) == 1
    assert len({r["matches"] for r in rows if "primary" not in r["operator"]}) == 1
