import time

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import vocab
from pathloom.llm.bpe import bpe_decode, bpe_encode, decode_ids, encode_texts, merge_one
from pathloom.llm.queries import queries
from pathloom.llm.textbatch import Texts, hashes, pretokens, words
from pathloom.llm import bpe, token_counts as tc
from pathloom.llm.token_binary import EliasFano, read_document, token_shards
from pathloom.llm.token_counts import count, token_counts

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
V = vocab.load()
TRUTH = tiktoken.Encoding("truth", pat_str=PATTERN, mergeable_ranks=V.ranks, special_tokens={})
alphabet = st.sampled_from(list(" \n\t'srevltmdaZ1²é日😀.,!-　 \u0085") + ["th", "ing", "'ll", "  ", "aaaa"])
texts = st.lists(st.lists(alphabet, max_size=30).map("".join), max_size=8)


@given(texts)
@settings(max_examples=400, deadline=None)
def test_ids_and_counts_equal_the_reference_encoder(ts):
    t = Texts.of(ts)
    ids, at = encode_texts(V, t)
    n, pieces = count(V, t)
    for i, text in enumerate(ts):
        want = TRUTH.encode_ordinary(text)
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert n[i] == len(want)
    back, ends = decode_ids(V, ids, at)
    assert [bytes(back[ends[i] : ends[i + 1]]).decode() for i in range(len(ts))] == ts


@pytest.mark.parametrize("word", ["a" * 3001, "abcdefghij" * 700, "the" * 2000, "z" * 1025, "Ω" * 600])
def test_long_words(word):
    want = TRUTH.encode_ordinary(word)
    assert encode_texts(V, Texts.of([word]))[0].tolist() == want
    assert count(V, Texts.of([word]))[0][0] == len(want)
    assert merge_one(V, V.byte_id[np.frombuffer(word.encode(), np.uint8)].tolist()) == want


@given(st.one_of(st.text("aeinst", min_size=2, max_size=400), st.lists(st.sampled_from(["aaaa", "th", "ing", "é", "日", "!!", "z"]), min_size=1, max_size=90).map("".join).filter(lambda t: len(t.encode()) > 1)))
@settings(max_examples=300, deadline=None)
def test_vast_words_merge_as_others_do(word):
    symbols = V.byte_id[np.frombuffer(word.encode(), np.uint8)]
    want = merge_one(V, symbols.tolist())
    assert bpe.merge_vast(V, symbols).tolist() == want
    assert tc.merge_vast(V, symbols) == len(want)


def test_vast_words_in_texts(monkeypatch):
    rng = np.random.default_rng(2)
    ts = ["x " + "".join(rng.choice(list("etaoin"), 3000)) + " y", "b" * 5001, " " * 4000 + "z"]
    monkeypatch.setattr(bpe, "VAST", 1000)
    monkeypatch.setattr(tc, "VAST", 1000)
    ids, at = encode_texts(V, Texts.of(ts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [TRUTH.encode_ordinary(t) for t in ts]
    assert count(V, Texts.of(ts))[0].tolist() == np.diff(at).tolist()


@given(texts)
@settings(max_examples=200, deadline=None)
def test_pretokens_and_words_equal_patterns(ts):
    import regex

    t = Texts.of(ts)
    starts, first = pretokens(t)
    for i, text in enumerate(ts):
        got = [bytes(t.data[starts[k] : starts[k + 1]]).decode() for k in range(first[i], first[i + 1])]
        assert got == regex.findall(PATTERN, text)
    s, e, f = words(t)
    for i, text in enumerate(ts):
        assert [bytes(t.data[s[k] : e[k]]).decode() for k in range(f[i], f[i + 1])] == regex.findall(r"[\p{L}\p{N}]+", text)


def test_hashes_depend_on_all_bytes():
    raw = ["", "\0", "\0\0", "a", "b", "abcdefgh", "abcdefgi", "abcdefgh\0", "x" * 300, "x" * 299 + "y", "x" * 16, "x" * 17]
    t = Texts.of(raw)
    h = hashes(t.data, t.offsets[:-1], t.offsets[1:])
    assert len(set(h.tolist())) == len(raw)
    assert h[3] == hashes(Texts.of(["a"]).data, np.array([0]), np.array([1]))[0]


def test_queries_over_the_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: TRUTH.encode_ordinary(t) for i, t in docs.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in queries()["op1_token_counts"](spark, sf).collect()}
    assert counts == {i: len(w) for i, w in want.items()}
    encoded = queries()["op7_bpe"](spark, sf)
    rows = encoded.collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == want
    assert all(r["decodes_back"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert {r["doc_id"]: r["text"] for r in bpe_decode(encoded).collect()} == docs
    shards = queries()["op2_token_binary"](spark, sf).collect()
    got = {d: read_document(s["ids"], s["boundaries"], s["width"], i).tolist() for s in shards for i, d in enumerate(s["doc_ids"])}
    assert got == want


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((repr(r["doc_id"]), None if r["text"] is None else len(TRUTH.encode_ordinary(r["text"]))) for r in rows)
    key = lambda t: (t[0], t[1] is None, t[1])
    assert sorted(((repr(r["doc_id"]), r["n_tokens"]) for r in token_counts(odd_docs).collect()), key=key) == sorted(want, key=key)
    encoded = bpe_encode(odd_docs, keep=("lang", "n.dots"))
    assert encoded.columns == ["doc_id", "lang", "n.dots", "token_ids", "n_tokens", "decodes_back"]
    got = encoded.collect()
    assert sorted(((repr(r["doc_id"]), r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)
    assert [r["token_ids"] for r in got if r["doc_id"] in (2, 3)] == [[], None]
    assert all(r["decodes_back"] for r in got if r["doc_id"] != 3)
    assert [r["text"] for r in bpe_decode(encoded).where("doc_id = 3 or doc_id = 2").orderBy("doc_id").collect()] == ["", None]
    for f in (token_counts, bpe_encode, token_shards):
        assert f(no_docs).count() == 0


def test_shards(odd_docs):
    shards = token_shards(odd_docs.coalesce(1).orderBy("doc_id"), shard_tokens=1000).collect()
    assert len({s["shard"] for s in shards}) == len(shards) > 2
    got = sorted((repr(d), len(read_document(s["ids"], s["boundaries"], s["width"], i))) for s in shards for i, d in enumerate(s["doc_ids"]))
    assert got == sorted((repr(r["doc_id"]), len(TRUTH.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect())
    assert all(s["n_tokens"] <= 1000 or len(s["doc_ids"]) == 1 for s in shards)


@given(st.lists(st.integers(0, 1 << 34), max_size=700).map(sorted))
@settings(max_examples=150, deadline=None)
def test_elias_fano(values):
    raw = EliasFano.build(np.array(values, np.uint64)).to_bytes()
    code = EliasFano.from_bytes(raw)
    assert code.values().tolist() == values
    assert [code.get(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        code.get(len(values))


def test_elias_fano_is_near_the_bound():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(0, 2000, 100_000)).astype(np.uint64)
    bits = 8 * len(EliasFano.build(values).to_bytes()) / len(values)
    assert bits < 2.3 + np.log2(values[-1] / len(values))
    with pytest.raises(ValueError):
        EliasFano.build(np.array([2, 1]))


HOSTILE = ["x" * 5_000_000, " " * 5_000_000 + "x", "\n" * 5_000_000, "<" + "a" * 5_000_000, "<script " * 625_000, "<div>x" * 833_000, "\u00e9" * 2_500_000]


@pytest.mark.parametrize("k", range(len(HOSTILE)))
def test_hostile_texts_take_seconds(k):
    """5 MB of one thing, which backtracking or quadratic code would not survive."""
    texts = Texts.of([HOSTILE[k], "after"])
    began = time.time()
    n, _ = count(V, texts)
    ids, at = encode_texts(V, texts)
    raw, ends = decode_ids(V, ids, at)
    assert time.time() - began < 30
    assert n.tolist() == np.diff(at).tolist() and raw.tobytes() == texts.data.tobytes() and ends.tolist() == texts.offsets.tolist()


def test_white_space_in_shards(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "a b")], "doc_id int, text string").coalesce(1)
    (row,) = token_shards(df, shard_tokens=1 << 30).collect()
    assert bytes(V.decode(read_document(row["ids"], row["boundaries"], row["width"], 0).astype(np.int64))) == b" " * 1_000_000 + b"x"
    assert read_document(row["ids"], row["boundaries"], row["width"], 1).tolist() == TRUTH.encode_ordinary("a b")


def test_decoding_odd_rows(spark):
    rows = [(1, [V.ranks[b"\xe6"], V.ranks[b"a"]]), (1, None), (None, []), (2, TRUTH.encode_ordinary("日本 x")), (2, TRUTH.encode_ordinary("日本 x"))]
    df = spark.createDataFrame(rows, "doc_id int, token_ids array<int>").withColumns({n: F.lit(1) for n in ("id", "text", "ids", "a.b")}).coalesce(1)
    assert [tuple(r) for r in bpe_decode(df).collect()] == [(1, "\ufffda"), (1, None), (None, ""), (2, "日本 x"), (2, "日本 x")]
    assert bpe_decode(df.limit(0)).count() == 0
    for bad in ([V.size], [None], [-1]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe_decode(spark.createDataFrame([(1, bad)], "doc_id int, token_ids array<int>")).collect()
    with pytest.raises(ValueError):
        bpe_decode(df, id_col="text")
    with pytest.raises(ValueError):
        bpe_encode(df.withColumn("N_Tokens", F.lit(1)).withColumn("text", F.lit("x")), keep=("N_Tokens",))


def test_lone_bytes_decode(spark):
    df = spark.createDataFrame([(1, [V.ranks[b"\xe6"]]), (2, [])], "doc_id int, token_ids array<int>")
    assert [r["text"] for r in bpe_decode(df).orderBy("doc_id").collect()] == ["�", ""]
    assert bpe_decode(df.where(F.lit(False))).count() == 0
