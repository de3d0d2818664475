import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockflow.llm import bpe, packing, token_count

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", "a  b", " x ", "\n\n  \t", "日本語テキスト①①", "a" * 1000, "ab" * 700 + " " * 40, "▁▁ ▁a", "<s> </s><unk>", "\x00", "é" * 300, "🙂🙂 " * 50, "a<|endoftext|>b<|endoftext|>", "'s't don't I'LL", "²½ ½x 12²", "tail ", "a \n b\n  c", " a 　b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def tools():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), token_count.RaggedCounter(PIECES), Tokenizer.from_file(BYTES), *bpe.encoder_of(BYTES)


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("ab  \n▁é日t①hein'sdl12²") for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["".join(rng.choice("abtheinor") for _ in range(rng.randint(200, 500))) for _ in range(20)]


def test_counts_are_the_library_s(tools):
    sp, counter, *_ = tools
    texts = ODD + random_texts(300)
    assert counter.count_texts(texts) == [len(sp.encode(t)) for t in texts]


def test_memory_bound_changes_nothing(tools):
    sp = tools[0]
    small = token_count.RaggedCounter(PIECES, remembered=3)
    assert [small.count_texts([t])[0] for t in ODD] == [len(sp.encode(t)) for t in ODD]


def test_counts_query(spark, docs, tools):
    sp = tools[0]
    extra = spark.createDataFrame([(None, "x y"), (7, None), (7, None), (8, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'z' AS n_tokens")
    got = sorted(map(tuple, token_count.token_counts(extra, PIECES, limit=1).collect()), key=str)
    assert got == sorted([(None, 3, len(sp.encode("x y")), True), (7, 0, 0, False), (7, 0, 0, False), (8, 0, 0, False)], key=str)
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, PIECES).collect()} == {r.doc_id: len(sp.encode(r.text)) for r in docs.collect()}
    assert token_count.token_counts(docs.limit(0), PIECES).count() == 0


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_ids_are_the_library_s(tools):
    _, _, tk, encoder, decoder = tools
    for t in ODD + random_texts(300):
        want = tk.encode(t, add_special_tokens=False).ids
        assert ids(encoder.encode(t)) == want
        assert decoder.decode(np.array(want, dtype="<u4")).decode() == tk.decode(want, skip_special_tokens=False)
        assert packing.ids_of(t, BYTES).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    encoder, decoder = bpe.encoder_of(BYTES)
    if "\ud800" <= max(text, default="a") <= "\udfff":
        return
    assert decoder.decode(np.frombuffer(encoder.encode(text), dtype="<u4")) == text.encode()


def test_digests(spark, docs, tools):
    tk = tools[2]
    odd = spark.createDataFrame([(1, None), (2, "a<|endoftext|> b")], "doc_id long, text string")
    for r in bpe.digests(docs.select("doc_id", "text").union(odd), BYTES).collect()[-2:] + bpe.digests(docs, BYTES).collect()[:30]:
        text = {1: "", 2: "a<|endoftext|> b"}.get(r.doc_id) if r.n_tokens < 8 and r.doc_id in (1, 2) else docs.where(docs.doc_id == r.doc_id).first().text
        want = tk.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    full = {r.doc_id: r.decoded for r in bpe.encode_decode(docs, BYTES).collect()}
    assert full == {r.doc_id: r.text for r in docs.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40))
def test_packing_is_whole_and_gapless(lengths):
    pieces = packing.pack(lengths, 32, least_cut=4)
    for item, n in enumerate(lengths):
        own = sorted((s, k) for i, s, k, _, _ in pieces if i == item)
        assert [s for s, _ in own] == list(np.cumsum([0, *[k for _, k in own]])[:-1]) and sum(k for _, k in own) == n
    by: dict = {}
    for _, _, k, seq, off in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert off == by.get(seq, 0)
        by[seq] = off + k
    assert sorted(by) == list(range(len(by))) and all(n <= 32 for n in by.values())
    assert sum(32 - n for n in by.values() if n & (n - 1)) <= 4 * len(by)


def test_packing_query(spark, docs, tools):
    tk = tools[2]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (5, ""), (5, "")], "doc_id long, text string"))
    got = packing.pack_documents(more, BYTES, group_rows=50).collect()
    assert sum(r.length for r in got) == sum(len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in more.collect())
    used: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert sum(2048 - n for n in used.values() if n & (n - 1)) < 0.02 * sum(used.values())
    for r in got[:60]:
        if r.doc_id is not None and r.doc_id != 5:
            whole = [*tk.encode(docs.where(docs.doc_id == r.doc_id).first().text, add_special_tokens=False).ids, 1]
            assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0
