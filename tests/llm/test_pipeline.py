"""All stages of the pipeline against brute force, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute as brute_groups
from test_models import planted, slow_score
from test_text_ops import brute_find, tokenizer_path

import corpus_pipeline
from millrace.llm import toxicity
from millrace.llm.queries import held_out

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def cut(text, items):
    """The text without its passages, each a line break; None if no word is left."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
    lowered = [w[0].lower() for w in words]
    hit = set()
    for _, item in items:
        own = re.findall(r"\w+", item.lower())
        size = min(10, len(own))
        for i in range(len(own) - size + 1):
            hit |= {k + j for k in range(len(words) - size + 1) if lowered[k : k + size] == own[i : i + size] for j in range(size)}
    if not hit:
        return text
    if len(hit) == len(words):
        return None
    pieces, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            pieces.append(text[at : words[k].start()])
        at = words[k].end()
    return "\n".join([*pieces, text[at:]])


def brute_mix(rows):
    """(row, copies) by the budgets of the sources."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {x: sum(size(r[1]) for r in rows if r[3] == x) for x in sources}
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sources)}
    full, target = set(), {}
    while True:
        left, w = sum(total.values()) - sum(3 * total[x] for x in full), sum(weight[x] for x in sources if x not in full)
        target = {x: 3 * total[x] if x in full else weight[x] * left / w for x in sources}
        over = {x for x in sources if x not in full and target[x] >= 3 * total[x]}
        if not over:
            break
        full |= over
    out = []
    for x in sources:
        own = sorted((r for r in rows if r[3] == x), key=lambda r: hashlib.md5(f"mix-1|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest())
        epochs, before = min(3, int(target[x] // total[x])) if total[x] else 0, 0
        for r in own:
            out.append((r, epochs + (before + size(r[1]) / 2 < target[x] - epochs * total[x])))
            before += size(r[1])
    return out


def test_all_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choice(["ba", "lo", "mi", "te"]) for _ in range(3)) for _ in range(n))
    passage = some(14)
    marked = planted(240, random.Random(12))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in marked]
    labels = [(i, y) for i, _, y in marked]
    clean = [t for _, t, y in marked if not y]
    rows += [(1000 + k, clean[k], "en", "s0", 1) for k in range(5)] + [(1100 + k, clean[k + 10] + " more", "en", None, 1) for k in range(5)]
    rows += [(1200 + k, f"{some(30)}, {passage.upper()}! {some(9)}", "en", "s1", None) for k in range(5)] + [(1300, passage, "en", "s2", 3), (1400, None, None, None, None), (1401, "", "x", "s1", 0), (None, some(12), None, "s1", 0)]
    items = [(1, passage), (2, some(25))]
    write(spark, tmp_path, rows, labels, items)
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~held_out(3, 1))
    scores = [slow_score(net, r[1] or "") for r in rows]
    assert all(abs(s - 0.7) > 1e-4 for s in scores)  # none is too close to call
    now = [r for r, s in zip(rows, scores) if s < 0.7]
    assert len(rows) - len(now) > 60
    kept = {i for i, _, least in brute_groups([(r[0], r[1]) for r in now], 5) if i == least}
    now = [r for r in now if r[0] in kept]
    assert not kept & {1000, 1101} and {1200, 1300, 1400, 1401, None} <= kept
    found = brute_find([r[1] for r in now], items)
    cleaned = [(r[0], cut(r[1], items), *r[2:]) for r in now]
    assert [c[1] != r[1] for c, r in zip(cleaned, now)] == [n > 0 for _, n, _ in found]
    now = [c for c, r in zip(cleaned, now) if not (c[1] is None and r[1])]
    assert 1300 not in {r[0] for r in now}
    want = Counter()
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_path())
    for r, copies in brute_mix(now):
        ids = [*real.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += copies
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == +want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and max(Counter(order).values()) > 1


@pytest.mark.parametrize("rows, labels, items", [([], [(1, 1)], [(1, "a b")]), ([(k, f"w{k} x", "en", "s", 1) for k in range(6)], [], []), ([(k, f"w{k} x", "en", None, 1) for k in range(6)], [(1, 1), (None, 0)], [(None, "w1 x"), (3, None)])])
def test_empty_tables_change_nothing(spark, tmp_path, rows, labels, items):
    write(spark, tmp_path, rows, labels, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]


def test_extra_columns_pass_through(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "s", 1) for k in range(4)]
    write(spark, tmp_path, rows, [(1, 1), (2, 0)], [(1, "w1x3 w1x4")])
    names = ["text_", "hits", "items", "score", "predicted", "_gone", "rest", "size", "taken", "kept"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in names:
        docs = docs.withColumn(name, docs.doc_id * 2)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert all(r[name] == 2 * r.doc_id for r in now.collect() for name in names)
