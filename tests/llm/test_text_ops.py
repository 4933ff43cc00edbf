"""PPM, decontamination, tokens, quality, chat: brute force, round trips and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import _bytes as B
from millrace.llm import chat, decontam, ppm, quality, template, tokens
from millrace.llm._suffix import suffix_order

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t\x0b\x0c\r ", "a", "A a", "x\x00y", "é É ß", "日本 語", "w " * 3000, "\n\n", "a  b\n a  b"]


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


# Hashes and suffixes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \né|", max_size=12), max_size=8))
def test_spans_and_hashes(texts):
    data, offs = B.string_buffers(pa.array(texts, pa.string()))
    starts, ends, counts = B.spans(B.SPACED[data], offs)
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    hashes = B.Hasher(data, lower=True)(starts, ends).tolist()
    lowered = [w.lower() for w in flat]
    assert all((hashes[i] == hashes[j]) == (lowered[i] == lowered[j]) for i in range(len(flat)) for j in range(i))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(text):
    order = suffix_order(np.array(text, np.int64))
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])


# Language model


def brute_ppm(texts, held, order):
    def tokens_of(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))

    def stream(t):
        return b"\n" * order + " ".join(tokens_of(t)).encode() + b"\n"

    contexts = {}
    for t, h in zip(texts, held):
        s = stream(t)
        for i in range(order, len(s)):
            for k in range(0 if h else order + 1):
                contexts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def log10(s, i, top, passed):
        out, hidden = 0.0, set()
        for k in range(top, -1, -1):
            c = contexts.get(s[i - k : i])
            if not c or s[i - k : i] in passed:
                continue
            left = {x: n for x, n in c.items() if x not in hidden}
            if left:
                n = sum(left.values())
                if s[i] in left:
                    return out + math.log10((2 * left[s[i]] - 1) / (2 * n))
                out += math.log10(len(left) / (2 * n))
            hidden = set(c)
        return out - math.log10(max(1, 256 - len(contexts.get(b"", ()))))

    passed = set()
    for k in range(2, order + 1):
        lower = set(passed)
        for c, followers in contexts.items():
            if len(c) == k:
                n, d = sum(followers.values()), len(followers)
                below = {x: log10(c + bytes([x]), k, k - 1, lower) for x in followers}
                everything, gain = sum(10.0**v for v in below.values()), 0.0
                for x, m in followers.items():
                    if m > 1:
                        gain += m * math.log10((2 * m - 3) / (2 * (n - 1)))
                    else:
                        gain += math.log10(max(d - 1, 0.5) / (2 * max(n - 1, 1))) + below[x] - math.log10(1 - min(everything - 10.0 ** below[x], 1 - 1e-9))
                    gain -= m * below[x]
                if n < 2 or gain <= 0:
                    passed.add(c)
    counts = Counter(w for t, h in zip(texts, held) if not h for w in [*tokens_of(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        s, own = stream(t), [*tokens_of(t), None]
        out.append((len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), sum(log10(s, i, order, passed) for i in range(order, len(s)))))
    return out


@pytest.mark.parametrize("order, group_bytes", [(3, 1), (5, 1 << 20), (6, 60)])
def test_ppm_against_brute_force(spark, order, group_bytes):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "theory", "Other", "then", "é", "a", "ab", "abc"]) for _ in range(rng.randrange(0, 25))) for _ in range(30)] + ODD
    held = [k % 5 == 2 for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id long, text string, out boolean").repartition(3)
    got = {r.doc_id: r for r in ppm.score(df, F.col("out"), order, group_bytes=group_bytes).collect()}
    for k, want in enumerate(brute_ppm(texts, held, order)):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.held_out == held[k]
        assert r.base_score == pytest.approx(want[3], rel=1e-9, abs=1e-9) and r.score == pytest.approx(want[4], rel=1e-5, abs=1e-5)


def test_ppm_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score(none, F.lit(False)).collect() == []
    rows = ppm.score(spark.createDataFrame([(1, "ab"), (None, "ab"), (1, "ab")], "doc_id long, text string"), F.lit(True)).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert all(r.score == pytest.approx(-3 * math.log10(256), rel=1e-6) for r in rows)


# Decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_find(docs, items, window=10):
    owners = {}
    for i, t in items:
        w = words_of(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                owners.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for p, own in owners.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(12)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(rng.randrange(1, 25))) for k in range(12)] + [(3, some(12)), (None, some(11)), (40, None), (41, "..."), (42, "V1,V2;v3")]
    docs = []
    for _ in range(40):
        text = some(rng.randrange(0, 60))
        if rng.random() < 0.7:
            text += " ZZ " + (rng.choice(items)[1] or "").upper() + "! " + some(3)
        docs.append(text)
    return docs + ODD, items


@pytest.mark.parametrize("group_bytes", [16 << 20, 300])
def test_find_passages(spark, group_bytes):
    texts, items = case(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("clash"))
    df = decontam.find_passages(docs, spark.createDataFrame(items, "item_id long, text string"), group_bytes=group_bytes)
    got = {r.doc_id: (r.n_words, sum(x.end - x.start for x in r["hits"]), r["items"]) for r in df.collect()}
    assert [got[k] for k in range(len(texts))] == brute_find(texts, items)


def test_find_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.find_passages(docs, items)).first().n_hit == 0
    assert decontam.find_passages(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).collect() == []


def test_remove_passages(spark):
    passage = " ".join(f"q{k}" for k in range(14))
    rows = [(1, f"Before, {passage}. After!"), (2, passage), (3, "clean text"), (4, None), (5, f"{passage}; {passage} é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    out = decontam.remove_passages(df, spark.createDataFrame([(9, passage)], "item_id long, text string"))
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before, \n. After!", 3: "clean text", 4: None, 5: "\n é"}
    assert all(r["hits"] == 1 for r in out.collect())


def test_passages_are_cut_where_they_are_found(spark):
    """One Python worker for each task, with one group of items and with several."""
    words = [f"w{k}" for k in range(60)]
    passages = [" ".join(words[a : a + 12]) for a in (0, 20, 40)]
    rows = [(k, f"before {passages[k % 3]} and {passages[(k + 1) % 3]} after") for k in range(6)] + [(6, None), (7, ""), (8, passages[0]), (9, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    for group_bytes in (16 << 20, 60):
        out = decontam.remove_passages(docs, items, group_bytes=group_bytes)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {r.doc_id: r.text for r in out.collect()} == {k: "before \n and \n after" for k in range(6)} | {6: None, 7: "", 9: "w1 w2"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index(text, pattern):
    text = np.array([*text, 0], np.int64)
    index = decontam.FMIndex(text, sample=3)
    which, lo, hi = index.search(np.array(pattern, np.int32), np.array([0]), np.array([0]), len(pattern))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
    assert found == [k for k in range(len(text)) if text[k : k + len(pattern)].tolist() == pattern]


# Token ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    packed = tokens.pack(np.array(values, np.uint64))
    assert tokens.unpack(packed, len(values)).tolist() == values
    lengths, ids = tokens.decode_block(tokens.encode_block(np.array([len(values), 0]), np.array(values, np.uint64)))
    assert lengths.tolist() == [len(values), 0] and ids.tolist() == values


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbtsREVLmld'59.,-<|> éÉß̱́̈÷×\n—ΣİſKH日٣")), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    encoder = tokens.encoder(tokenizer_path(), 2)
    texts = [*texts, "a<|endoftext|>b I'LL ,'s"]
    lengths, ids = encoder.encode(*B.string_buffers(pa.array(texts, pa.string())))
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert isinstance(tokens.encoder(path, 50256), tokens.TextEncoder) and isinstance(tokens.encoder(tokenizer_path(), 2), tokens.WordEncoder)
    texts = [*ODD, "Plain words, 12 of them!", "a<|endoftext|>b  c", "I'LL it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.tokenize(df, path, 50256).collect()}
    real = Tokenizer.from_file(path)
    ids = [[*real.encode(t or "", add_special_tokens=False).ids, 50256] for t in texts]
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}
    told = json.loads(open(tokenizer_path()).read())  # a small change of the known file is another tokenizer
    told["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(told))
    assert isinstance(tokens.encoder(str(tmp_path / "cased.json"), 2), tokens.TextEncoder)


def test_token_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(ODD)] + [(10**9, "twice"), (None, "none")], "doc_id long, text string"))
    got = tokens.tokenize(docs.repartition(5), tokenizer_path(), block_ids=500).collect()
    encoder, at, seen = tokens.encoder(tokenizer_path(), 2), 0, {}
    for r in docs.collect():
        ids = [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        seen.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.n_tokens, r.ids_crc32) in seen[r.doc_id]
        seen[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(seen.values())
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert tokens.tokenize(docs.limit(0), tokenizer_path()).collect() == []


# Quality


def brute_repeats(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while j != i and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=6))
def test_longest_repeats(texts):
    data, offs = B.string_buffers(pa.array([" ".join(t) for t in texts], pa.string()))
    starts, ends, counts = B.spans(B.SPACED[data], offs)
    got = quality.longest_repeats(B.Hasher(data)(starts, ends), counts).tolist()
    assert got == [x for t in texts for x in brute_repeats(t)]


def test_quality_rules(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice("abcdefgh#é") for _ in range(rng.randrange(0, 90))).replace(" h", "\nh") for _ in range(60)]
    some = " ".join(f"x{k}" for k in range(60))
    texts += [some, some + "\n" + " ".join(f"y{k}" for k in range(300)) + "\n" + " ".join(f"x{k}" for k in range(60)), " ".join(f"x{k}" for k in range(80)) + " " + " ".join(f"z{k}" for k in range(100)) + " " + " ".join(f"x{k}" for k in range(80))]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        threes = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) for j in range(3) if threes[tuple(words[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(repeated), failed)
        best = brute_repeats(words) if len(words) < 1000 else None
        if best is not None:
            spans = {k + j for k, n in enumerate(best) if n >= 10 for j in range(n)}
            assert r.longest_repeat == max(best, default=0) and r.repeat_fraction == pytest.approx(len(spans) / max(1, len(words)))
            assert r.kept == (not failed and r.repeat_fraction <= 0.3 and r.longest_repeat <= 200)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Templates and chat


def test_template_language():
    render = template.render
    source = "{% set n = 1 + 2 %}{% for m in ms -%}  {{ loop.index }}/{{ loop.last }}:{{ m['t'] | trim | upper }}{{ ',' if not loop.last else '.' }}{% endfor %}{# note #}{{ n }}"
    assert render(source, ms=iter([{"t": " a "}, {"t": "b"}])) == "1/false:A,2/true:B.3"
    assert render("{% if a == 'x' and not b %}1{% elif a in 'yz' %}2{% else %}3{% endif %}", a="z", b=0) == "2"
    assert render("{{ missing }}{{ 'a' ~ 1 ~ none ~ true }}{{ 7 % 4 }}") == "a1true3"
    pieces = list(template.compile_template("a{% generation %}{{ x }}b{% endgeneration %}c")(x="é"))
    assert pieces == [("a", False), ("é", True), ("b", True), ("c", False)]


def test_constants_are_folded():
    tree = template.fold(template.parse("a{{ 'b' + 'c' | upper }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}e"))
    assert tree == (template.Emit(template.Const("abCde")),)


def test_folding_leaves_branches_never_taken_alone():
    for source, want in (("{% if false %}{{ 1 % 0 }}{% endif %}a", "a"), ("{% if true %}b{% else %}{{ 1 < 'x' }}{% endif %}", "b"), ("{{ 'c' if true else 1 % 0 }}", "c"), ("{{ false and 1 % 0 }}", "false")):
        assert template.render(source) == want
    for source in ("{{ 1 % 0 }}", "{{ 1 < 'x' }}", "{{ 5 | length }}", "{{ x + 1 }}", "{{ x in 5 }}"):
        write = template.compile_template(source)  # compiles: it fails where it is rendered
        with pytest.raises(template.TemplateError):
            list(write(x=None))


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ x", "{{ x.y() }}", "{{ open('f') }}", "{% import os %}", "{{ 1 + }}", "{{ x | nothing }}", "{% for %}{% endfor %}"])
def test_bad_templates(bad):
    if bad == "{{ x":
        assert template.render(bad) == bad
        return
    with pytest.raises(template.TemplateError):
        template.render(bad, x={"y": 1})


def test_sandbox():
    with pytest.raises(template.TemplateError):
        template.render("{{ x.__class__ }}", x="text")
    assert template.render("{{ x.__class__ }}", x={}) == ""


ROLES = st.sampled_from(["user", "assistant", "system", "tool>>", "", "a\\l<>["])
TEXTS = st.text(alphabet=st.sampled_from(list("ab<>[]/\\slINST\n é")), max_size=20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=8))
def test_turns_are_read_back(turns):
    write = template.compile_template(chat.TEMPLATE, chat.FILTERS)
    pieces = [p for p, _ in write(messages=iter({"role": r, "text": t} for r, t in turns))]
    assert list(chat.turns_of(iter(pieces))) == turns
    assert list(chat.turns_of(iter(["".join(pieces)]))) == turns


def test_chat_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", "</s>"), (2, 5, "assistant", "b"), (2, 4, "assistant", "a"), (3, 0, "user", "u" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    whole = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in whole.items()} == {1: 3, None: 1, 2: 2, 3: 1}
    assert whole[2].loss_chars == 2 and whole[None].loss_chars == 4 and whole[1].loss_chars == 0
    import hashlib

    assert whole[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert whole[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\n\nx\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
