import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rarefy.llm import bpe as B

from .helpers import HAVE, SF, docs, edges, table

POOL = "abcdeéèñßthion \n\t'sS0123,.!?$%—“”日本語한국а́бв  \u0085😀👩‍👩‍👧"


@pytest.fixture(scope="module")
def own():
    return B.load(B.vocabulary())


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(B.vocabulary()), special_tokens={})


def test_every_code_point(own, other):
    texts = [f"a{c}b {c}{c} 1{c}2  {c} x{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000][::7]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == other.encode_ordinary(t), t


def test_random_texts(own, other):
    r = random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice(POOL) for _ in range(r.randint(0, 80)))
        (ids,) = own.encode([t])
        assert ids.tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
        starts, ends = own.offsets(ids)
        whole = np.zeros(len(t), bool)
        for i, (s, e) in enumerate(zip(starts, ends)):
            whole[s:e] = True
            assert other.decode_single_token_bytes(int(ids[i])) in t[s:e].encode()
        assert whole.all()


def test_special_strings_are_text(own):
    (ids,) = own.encode(["<|endoftext|> <s>"])
    assert own.decode(ids) == b"<|endoftext|> <s>" and len(ids) > 4


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark, other):
    got = table(B.op6_bpe(spark, SF)).set_index("doc_id")
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(other.encode_ordinary(r.text), "<u4")
        row = got.loc[r.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_edges(spark):
    df = edges(spark)
    encoded = B.encode(df, offsets=True)
    texts = sorted((r.text or "").encode() for r in df.collect())
    assert sorted(bytes(r.bytes) for r in B.decode(encoded).collect()) == texts
    assert sorted(r.n_tokens for r in encoded.collect())[:2] == [0, 0]
    assert B.encode_checked(df).count() == 13
    assert table(B.encode_checked(docs(spark, []))).empty
    assert B.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().bytes == b""
