"""MinHash near-dedup against brute force, star rounds, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import _bytes as B
from millrace.llm import components, minhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            linked = sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if same_id or (linked and rows[i][0] is not None and rows[j][0] is not None):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, shingle=width).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    rows, k = [], 0
    for size in (1, 1, 2, 3, 60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            k += 1
            rows.append((k * 7 % 1009, " ".join(edited(rng, base, rng.randrange(0, 14)))))
    rows += [(2000 + i, "Same Text again") for i in range(30)] + [(3000, "one"), (3001, "ONE"), (3002, "one two"), (3003, None), (3004, ""), (3005, " \n\t"), (None, "one"), (None, None)]
    rng.shuffle(rows)
    assert run(spark, rows, width) == brute(rows, width)


def test_rows_of_one_id_are_one_vertex(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (9, "q r s t u v w"), (9, "q r s t u v w")]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_chain_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(4)
    words, rows = [f"w{k}" for k in range(150)], []
    for k in range(50):  # each text differs from the one before by little, the first and last by much
        rows.append((k, " ".join(words)))
        words = edited(rng, words, 6)
    assert run(spark, rows, 2) == brute(rows, 2)


def test_a_bucket_of_unlike_sets(spark):
    """5,000 texts share the minima of one band and little else; a few of them are linked."""
    rng = np.random.default_rng(6)
    words = np.array([f"q{k}" for k in range(60_000)])
    data, offs = B.string_buffers(pa.array([f"{a} {b}" for a, b in zip(words, rng.permutation(words))]))
    elements, sizes = minhash.shingle_sets(data, offs, 2)
    assert (sizes == 1).all()
    raw = data.tobytes().decode()
    least = [int((elements * minhash._A[k] + minhash._B[k]).argmin()) for k in range(minhash.ROWS)]
    common = " ".join(raw[offs[k] : offs[k + 1]] for k in least)
    texts = [[common, *(f"u{k}x{j}" for j in range(14))] for k in range(5000)]
    linked = {}
    for k in range(0, 300, 3):  # a copy with one word more
        texts[k + 2500] = [*texts[k], "more"]
        linked[k + 2500] = k
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    data, offs = B.string_buffers(pa.array([t for _, t in rows]))
    sig = minhash.minima(*minhash.shingle_sets(data, offs, 2))
    assert (sig[:, : minhash.ROWS] == sig[0, : minhash.ROWS]).all(axis=1).sum() > 4900
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == {k: linked.get(k, k) for k in range(5000)}


@pytest.mark.parametrize("less, together", [(0, True), (1, False)])
def test_very_long_texts_on_the_threshold(spark, less, together):
    both, own = 400_000, 50_000
    shared = [f"s{k}" for k in range(both - less)]
    a, b = ([*shared, *(f"{side}{k}" for k in range(own + (less if side == "a" else 0)))] for side in "ab")
    # |both| / |union| is 400,000 / 500,000, or one shingle less
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "s1 s2")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=1).collect()}
    assert got == {1: 1, 2: 1 if together else 2, 3: 3}


def test_blocks_join_components_by_few_exact_links():
    shared, sig = " ".join(f"s{k}" for k in range(400_000)), bytes(4 * minhash.BANDS * minhash.ROWS)
    own = lambda c, n=50_000: " ".join(f"{c}{k}" for k in range(n))
    texts = {5: f"{shared} {own('a')}", 6: f"{shared} {own('b')}", 7: f"{shared} {own('c', 50_001)}", 8: "q r", 9: "q r"}
    rows = [(0, 0, 0, k, k, sig, side, t) for k, t in texts.items() for side in (0, 1)]
    table = pa.table(dict(zip(("band", "i", "j", "cls", "comp", "sig", "side", "text"), map(list, zip(*rows)))))
    got = {frozenset((r["a"], r["b"])) for r in minhash._meet(1, 80)(table).to_pylist()}
    assert got == {frozenset((5, 6)), frozenset((8, 9))}  # 400,000 of 500,000, and one more


def test_empty_and_extra_columns(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "x", 9)], "doc_id long, text string, component_id int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.vertex: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_minima_estimate_similarity():
    texts = [" ".join(map(str, range(0, 400))), " ".join(map(str, range(0, 360)))]
    data, offs = B.string_buffers(pa.array(texts))
    elements, sizes = minhash.shingle_sets(data, offs, 2)
    sig = minhash.minima(elements, sizes)
    assert sizes.tolist() == [399, 359]
    assert abs(np.mean(sig[0] == sig[1]) - 359 / 399) < 0.12
