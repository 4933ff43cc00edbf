"""A text beyond a chunk, clashing column names and repeated rows, through every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import _bytes as B
from millrace.llm import chat, decontam, langid, linededup, minhash, mixing, ppm, quality, tokens, toxicity

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 9))) for _ in range(20_000)]
LONG = "\n".join(" ".join(RNG.choice(WORDS) for _ in range(12)) for _ in range(56_000))
N = 56_000 * 12
SHORT = " ".join(f"x{k}" for k in range(60))
CLASHES = ["held_out", "n_tokens", "score", "text_a", "cls", "band", "unit", "kind", "hits", "items", "kept", "row", "line", "size", "source", "taken", "predicted", "lang_pred", "rest", "start", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > B.CHUNK
    df = spark.createDataFrame([(1, LONG), (2, SHORT), (2, SHORT), (3, None)], "doc_id long, text string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES if c != "source"), F.lit("s").alias("source"))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_lm_scoring(docs):
    got = by_id(ppm.score(docs, F.col("doc_id") == 2, order=3))
    assert (got[1].n_tokens, got[2].n_tokens, got[3].n_tokens) == (N + 1, 61, 1) and got[1].train_tokens == N + 2
    assert got[1].n_bytes == len(LONG) + 1 and got[1].score < 0 and not got[1].held_out and got[2].held_out


def test_near_dedup(docs):
    got = by_id(minhash.near_duplicates(docs, shingle=2))
    words = LONG.split()
    assert got[1].n_shingles == len(set(zip(words, words[1:]))) and [got[k].component_id for k in (1, 2, 3)] == [1, 2, 3]
    assert minhash.keep_one(docs).columns == docs.columns


def test_line_dedup(docs):
    got = by_id(linededup.dedup_lines(docs))
    assert got[1].n_lines == 56_000 and got[1].n_removed == 0 and got[1].clean_text == LONG and got[3].clean_text is None


def test_language_id(docs):
    tagger = langid.train([LONG[:2000], "x1 x2 x3 x4 " * 50], ["a", "b"])
    got = by_id(langid.predict(docs, tagger))
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["a", "b", "und"] and got[1].rest == 7


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", LONG), (1, 2, "user", None)], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("loss", F.lit(2))
    r = chat.read_back(chat.format_conversations(rows)).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, len(LONG), hashlib.sha256(LONG.encode()).hexdigest())


def test_tokens(docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = docs.withColumn("block", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("payload", F.lit(1))
    got = sorted(tokens.tokenize(rows, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 2, 3] and got[3].n_tokens == 1
    ids = [*tokens.encoder(path, 2).tokenizer.encode(LONG, add_special_tokens=False).ids, 2]
    assert (got[0].n_tokens, got[0].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_decontamination(docs, spark):
    passage = " ".join(LONG.split()[400_000:400_020])
    items = spark.createDataFrame([(5, passage), (6, "x7 x8"), (7, None)], "item_id long, text string").withColumn("hits", F.lit(1))
    got = by_id(decontam.find_passages(docs, items))
    assert got[1].n_words == N and got[1]["items"] == ["5"] and any(x.start <= 400_000 and x.end >= 400_020 for x in got[1].hits)
    assert got[2]["items"] == ["6"] and [tuple(x) for x in got[2].hits] == [(7, 9)] and got[3].hits == []
    assert decontam.remove_passages(docs, items).columns == docs.columns


def test_mixing(docs):
    out = mixing.mix(docs)
    assert {r.doc_id: r.size for r in out.collect()} == {1: N, 2: 60, 3: 0} and out.columns.count("taken") == 1
    assert mixing.take(out).count() == 4  # one source: its target is its size


def test_toxicity(docs):
    net = toxicity.train([LONG[:3000], SHORT] * 30, [0, 1] * 30, epochs=1)
    got = by_id(toxicity.score(docs, net))
    assert got[3].score == 0 and 0 < got[1].score < 1 and 0 < got[2].score < 1
    assert toxicity.reject(docs, net).columns == docs.columns


def test_quality(docs):
    got = by_id(quality.judge(docs))
    assert got[1].n_words == N and got[1].word_chars == len(LONG) - N + 1 and got[1].longest_repeat < 10 and got[2].kept and got[3].base_failed


def test_empty_tables_with_clashing_names(docs):
    none = docs.limit(0)
    net = toxicity.Network()
    for out in (ppm.score(none, F.lit(False)), minhash.near_duplicates(none), linededup.dedup_lines(none), langid.predict(none, None), mixing.mix(none), toxicity.reject(none, net), quality.judge(none)):
        assert out.collect() == []
