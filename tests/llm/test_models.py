"""Language ID and toxicity: gradients, held-out accuracy, odd rows; and the pipeline."""

import copy
import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _bytes as B
from millrace.llm import _features, decontam, langid, toxicity
from millrace.llm._features import Words
from millrace.llm.queries import held_out

ODD = [None, "", " \n", "123 456", "...", "a", "é", "x " * 3000]


# Language ID


def test_forward_backward():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    got, expected, normal = langid.forward_backward(emit, move, mask)
    pairs = np.zeros((3, 3))
    for s, n in ((0, 4), (1, 2)):
        total, marginal, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=n):
            w = np.exp(sum(emit[t, s, y[t]] for t in range(n)) + sum(move[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            for t in range(n):
                marginal[t, y[t]] += w
            for t in range(n - 1):
                own[y[t], y[t + 1]] += w
        pairs += own / total
        assert np.allclose(marginal / total, got[:n, s]) and np.isclose(np.log(total), normal[s])
    assert np.allclose(pairs, expected)


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 40])
def test_blocks_give_the_marginals_of_the_whole(n, monkeypatch):
    monkeypatch.setattr(langid, "LONG", 4)
    monkeypatch.setattr(langid, "STEP", 6)
    rng = np.random.default_rng(n)
    tagger = langid.Tagger(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    emit = rng.normal(scale=3, size=(n + 3, 3)).astype(np.float32)
    whole, _, _ = langid.forward_backward(emit[3:, None], tagger.move, np.ones((n, 1), bool))
    got = tagger.marginals(emit, np.array([3, n]), width=20)
    assert np.allclose(got[3:], whole[:, 0], atol=1e-5)


def slow_label(tagger, text):
    """Words, hashed features and all labellings of a short text, one by one."""
    def at(raw, salt=0):
        h = B.Hasher(np.frombuffer(raw, np.uint8))(np.array([0]), np.array([len(raw)]))
        return int((B.mix(h + np.uint64(salt)) if salt else h)[0] % np.uint64(langid.TABLE))

    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(ascii_lower))
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    weights, move = tagger.weights.astype(float), tagger.move.astype(float)
    emit = []
    for w in (w.encode() for w in words):
        marked = b"^" + w + b"$"
        found = [at(marked[k : k + n]) for n in langid.SIZES for k in range(len(marked) - n + 1)] + [at(w)]
        found += [x for n in langid.AFFIXES for x in (at(w[:n], n), at(w[-n:], 64 + n))]
        emit.append(sum(weights[f] for f in found))
    labels = range(len(tagger.languages))
    share, total = np.zeros(len(labels)), 0.0
    for y in itertools.product(labels, repeat=len(words)):
        p = np.exp(sum(emit[t][y[t]] for t in range(len(y))) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        total += p
        for t, w in enumerate(words):
            share[y[t]] += p * any(map(str.isalpha, w))
    return tagger.languages[int(share.argmax())], share.max() / share.sum()


def test_labels_against_brute_force():
    tagger = langid.train(["la casa blanca es grande", "the white house is big", "das weisse haus ist gross"] * 3, ["es", "en", "de"] * 3)
    texts = ["la house", "Casa 12 the \u2014 x", "haus", "the white casa es gross", "12 34", "", "\u00c9t\u00e9 ist 7", "is is is la la", "\u6f22 the"]
    best, score = tagger.label(*B.string_buffers(pa.array(texts)))
    for k, text in enumerate(texts):
        lang, share = slow_label(tagger, text)
        assert (tagger.languages[best[k]] if best[k] >= 0 else "und") == lang and score[k] == pytest.approx(share, abs=1e-4)


NO_LETTERS = ["\u2014 \u2026 \u201c\u201d", "\u20ac \u00a3 \u00d7", "\u3002\u3001\uff01", "\U0001f600\U0001f600", "\u00a0", "\u0663\u0664\u0665", "\u00bf?", "\u00bd \u00b2", "\u2160\u0301", "7"]
LETTERS = ["\u00e9", "\u6f22", "\u0431", "\u2014 x", "\u00aa", "\U00010400", "3\u00b2\u02b0", "\u05d0"]


def test_letters_are_code_points(spark):
    for k, text in enumerate([*NO_LETTERS, *LETTERS]):
        data = np.frombuffer(text.encode(), np.uint8)
        assert B.letters(data).sum() == sum(map(str.isalpha, text)), text
        assert B.letters(data).any() == (k >= len(NO_LETTERS))
    df = spark.createDataFrame(list(enumerate([*NO_LETTERS, *LETTERS])), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.train(["la casa blanca", "the white house"], ["es", "en"])).collect()}
    assert all(got[k] == ("und", 0.0) for k in range(len(NO_LETTERS)))
    assert all(got[len(NO_LETTERS) + k][0] in ("es", "en") for k in range(len(LETTERS)))


def test_a_very_long_text_is_labelled_in_bounded_time():
    rng = random.Random(5)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(n))
    tagger = langid.train([make(["ba", "lo", "mi"], 40) for _ in range(30)] + [make(["krz", "szt", "owk"], 40) for _ in range(30)], ["a"] * 30 + ["b"] * 30)
    text = (make(["krz", "szt", "owk"], 3000) + " ") * 1000  # 20 MB
    began = time.perf_counter()
    best, score = tagger.label(*B.string_buffers(pa.array([text, "lomi balo"])))
    assert time.perf_counter() - began < 20 and best.tolist() == [1, 0] and score[0] > 0.95


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("clash"))
    tagger = langid.fit(docs, ~held_out(4, 2))
    rows = langid.predict(docs.withColumn("held", held_out(4, 2)), tagger).filter("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_words_are_labelled_in_mixed_text():
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(40))
    a, b = ["ba", "lo", "mi"], ["krz", "szt", "owk"]
    tagger = langid.train([make(a) for _ in range(40)] + [make(b) for _ in range(40)], ["a"] * 40 + ["b"] * 40)
    data, offs = B.string_buffers(pa.array([make(a) + " " + make(b)]))
    words = Words(data, offs)
    got = tagger.marginals(tagger.emissions(words)[words.which], words.counts)
    assert (got[:40].argmax(axis=1) == 0).mean() > 0.95 and (got[40:].argmax(axis=1) == 1).mean() > 0.95
    assert tagger.move[0, 0] > tagger.move[0, 1]


def test_language_odd_rows(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    tagger = langid.train(["la casa", "the house"], ["es", "en"])
    got = {r.doc_id: r for r in langid.predict(df, tagger).collect()}
    assert [got[k].lang_pred for k in range(5)] == ["und"] * 5 and got[0].score == 0
    assert all(got[k].lang_pred in ("en", "es") for k in (5, 6, 7))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(empty, tagger).collect() == []


# Toxicity


def test_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = Words(*B.string_buffers(pa.array(["alpha beta gamma delta " * 12, "idiot moron"])))
    x, made_of = net.inputs(words)
    index, owner = toxicity.windows(words.counts)
    index, label = np.where(index >= 0, words.which[index], -1), np.array([0.0, 1.0])[owner]

    def loss(n):
        y, _ = n.inputs(words)
        p = toxicity._sigmoid(n.run(y, index))
        return -np.mean(np.where(label > 0, np.log(p), np.log(1 - p)))

    taught = copy.deepcopy(net)
    taught.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in taught.p.items()}
    taught.learn(x, made_of, index, label, 0.0)
    for name in net.p:
        gradient = taught.moments[name][0] / 0.1
        at = np.abs(gradient).argmax()
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        up.p[name].ravel()[at] += 1e-3
        down.p[name].ravel()[at] -= 1e-3
        assert gradient.ravel()[at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=1e-2, abs=1e-6)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        index, doc = toxicity.windows(np.array([3, n]))
        assert sorted({i for i in index[doc == 1].ravel().tolist() if i >= 0}) == list(range(3, 3 + n))


def slow_score(net, text):
    """Words, windows, gated units and attention, one number at a time."""
    def sig(v):
        return 1 / (1 + np.exp(-v))

    def index_of(raw, table, salt=0):  # the same hash, of one piece
        h = B.Hasher(np.frombuffer(raw, np.uint8))(np.array([0]), np.array([len(raw)]))
        return int((B.mix(h + np.uint64(salt)) if salt else h)[0] % np.uint64(table))

    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w.encode() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(ascii_lower))]
    x = []
    for w in words:
        marked = b"^" + w + b"$"
        grams = [index_of(marked[k : k + n], toxicity.TABLES["char"]) for n in toxicity.SIZES for k in range(len(marked) - n + 1)]
        stems = [index_of(w[:n], toxicity.TABLES["stem"], n) for n in toxicity.STEMS]
        x.append(p["word"][index_of(w, toxicity.TABLES["word"])] + sum((p["char"][g] for g in grams), 0 * p["word"][0]) / max(1, len(grams)) + sum(p["stem"][s] for s in stems) / len(stems))
    best, at, size = 0.0, 0, toxicity.WINDOW
    while words:
        inside = x[at : at + size]
        states = []
        for side, order in (("f", inside), ("b", inside[::-1])):
            h, H, out = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN, []
            for v in order:
                g = v @ p[f"W{side}"] + p[f"b{side}"]
                z, r = sig(g[:H] + h @ p[f"U{side}"][:, :H]), sig(g[H : 2 * H] + h @ p[f"U{side}"][:, H : 2 * H])
                c = np.tanh(g[2 * H :] + (r * h) @ p[f"U{side}"][:, 2 * H :])
                h = (1 - z) * h + z * c
                out.append(h)
            states.append(out if side == "f" else out[::-1])
        both = [np.concatenate(s) for s in zip(*states)]
        e = np.array([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in both])
        a = np.exp(e - e.max())
        pooled = sum(w * s for w, s in zip(a / a.sum(), both))
        best = max(best, float(sig(pooled @ p["w"] + p["c"])[0]))
        if at + size >= len(x):
            return best
        at += toxicity.STRIDE
    return best


def test_scores_against_brute_force():
    rows = planted(90, random.Random(2))
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=2)
    rng = random.Random(4)
    texts = [t for _, t, _ in rows[:6]] + ["", "...", "a", "Vilba, É 日本 x1!", "vilbami " * 33, " ".join(rng.choice(["ba", "vilte", "lomi"]) for _ in range(57))]
    got = net.score(*B.string_buffers(pa.array(texts)))
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-5) and len(set(got.round(6))) > 6


def planted(n, rng):
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(["ba", "lo", "mi", "te"]) for _ in range(3)) for _ in range(rng.randrange(20, 120))]
        if toxic := int(k % 3 == 0):
            for _ in range(3):
                words[rng.randrange(len(words))] = "vil" + rng.choice(["ba", "lo", "mi", "te"]) + rng.choice(["ba", "lo", "mi", "te"])
        rows.append((k, " ".join(words), toxic))
    return rows


def test_features_are_hashed_in_parts_and_once(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(np.array(list("abcdefgh"))[rng.integers(0, 8, (400, 9))].view("U9").ravel()) for _ in range(150)]
    words = Words.of(texts)
    tracemalloc.start()
    whole = words.ngrams(toxicity.SIZES, toxicity.TABLES["char"])
    took = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.keys) > 50_000 and took < 3 * sum(x.nbytes for x in whole)
    stems = words.prefixes(toxicity.STEMS, toxicity.TABLES["stem"])
    monkeypatch.setattr(_features, "PART", 1_003)
    assert all(np.array_equal(a, b) for a, b in zip(whole, words.ngrams(toxicity.SIZES, toxicity.TABLES["char"])))
    assert np.array_equal(stems, words.prefixes(toxicity.STEMS, toxicity.TABLES["stem"]))
    calls = []
    monkeypatch.setattr(Words, "ngrams", lambda *a, own=Words.ngrams: calls.append(1) or own(*a))
    rows = planted(60, random.Random(1))
    assert toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=3) and len(calls) == 1
    assert toxicity.train([None, "", "...", *(t for _, t, _ in rows)], [0, 1, 0, *(y for _, _, y in rows)], epochs=1)
    assert toxicity.train(["", "..."], [0, 1], epochs=1) is None


def test_toxicity_on_held_out_rows(spark):
    rows = planted(900, random.Random(3))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, ~held_out(3, 1))
    got = {r.doc_id: r for r in toxicity.score(docs, net).filter(held_out(3, 1)).collect()}
    right = [got[i].predicted == y for i, _, y in rows if i in got]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in toxicity.reject(docs, net).collect()} >= {i for i in got if got[i].predicted == 0}
    assert toxicity.reject(docs, net).columns == docs.columns


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    net = toxicity.train([t for _, t, _ in planted(60, random.Random(1))], [y for _, _, y in planted(60, random.Random(1))], epochs=1)
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert got[0] == got[1] == got[2] == 0 and len(got) == len(ODD)
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels, F.lit(True)) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), net).collect() == []


# Pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(9)
    passage, around = (" ".join("".join(rng.choice(["ba", "lo", "mi", "te"]) for _ in range(3)) for _ in range(n)) for n in (15, 30))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t, _ in planted(120, random.Random(9))]
    toxic = {i for i, _, y in planted(120, random.Random(9)) if y}
    rows += [(1000, rows[1][1], "en", "s0", 1), (1001, rows[2][1] + " more", "en", None, 1), (1002, f"{around} {passage} lolo", "en", "s1", None), (1003, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        seen.append({r.doc_id: r.text for r in now.collect()})
    assert len(toxic & set(seen[0])) <= 2 and len(set(range(120)) - toxic - set(seen[0])) <= 2
    assert 1000 not in seen[1] and 1001 not in seen[1] and {1, 2, 1002, 1003} <= set(seen[1])
    assert passage not in (seen[2][1002] or "") and seen[2][1002].startswith(around) and seen[2][4] == seen[1][4]
    out = corpus_pipeline.run(spark, folder).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    assert not set(decontam.ADDED) & set(now.columns)  # the hits' columns never leak into documents
