import hashlib

import numpy as np
import pytest
import regex
import xxhash

from rarefy.llm import imatch as I

from .helpers import HAVE, SF, docs, edges, table


def plain(rows):
    """doc_id -> (n_chars, edited_sha256) for rows (id, text) with distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    return out


def lexicon_of(texts, low, high):
    df = {}
    for t in texts:
        for w in set(regex.split(r"[^\p{L}\p{N}]+", t.lower())) - {""}:
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    return {w for w, k in df.items() if max(2.0, low * n) <= k <= max(2.0, high * n)}


def test_lexicon(spark, rng):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[int(i)] for i in rng.integers(0, 40, 12)) + "." for _ in range(50)]
    got = I.lexicon(docs(spark, list(enumerate(texts))), 1 / 20, 1 / 5)
    expected = lexicon_of(texts, 1 / 20, 1 / 5)
    hashes = {r.h for r in spark.createDataFrame([(w,) for w in expected], "w string").selectExpr("xxhash64(w) AS h").collect()} if expected else set()
    assert {r.term for r in got.collect()} == hashes


@pytest.mark.parametrize("block_rows", [3, 1500])
def test_pairs(spark, rng, monkeypatch, block_rows):
    monkeypatch.setattr(I, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(I, "_CHUNK", 4)
    words = [f"word{i}é" for i in range(300)]
    rows = [(int(i) * 3 - 50, " ".join(words[int(k)] for k in rng.integers(0, 300, rng.integers(0, 60)))) for i in range(80)]
    rows[11] = (rows[11][0], rows[40][1])
    got = table(I.fingerprint_pairs(docs(spark, rows).repartition(5))).set_index("doc_id")
    expected = plain(rows)
    assert sorted(got.index) == sorted(expected)
    for i, (n, sha) in expected.items():
        assert (got.n_chars[i], got.edited_sha256[i]) == (n, sha)
    assert got.fingerprint[rows[11][0]] == got.fingerprint[rows[40][0]]
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > got.near_next.mean()
    brute(rows, got)


def spark_hash(*values):
    """XXH64 as SQL's xxhash64 chains it: text as UTF-8, integers of 4 bytes (numpy int32) or 8."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
        h_signed = h - (1 << 64) if h >> 63 else h
    return h_signed


def brute(rows, got):
    """Fingerprints and likenesses of every row, by sets of terms in plain Python."""
    terms = lambda t: {spark_hash(w) for w in set(regex.split(r"[^\p{L}\p{N}]+", t.lower())) - {""}}
    words = lexicon_of([t for _, t in rows], I.LOW, I.HIGH)
    parts = {}
    for w in words:
        h = spark_hash(w)
        parts[h] = [k for k in range(I.SUBSETS) if spark_hash(h, np.int32(k)) % I.DENSITIES[k % len(I.DENSITIES)] == 0]

    def signature(t):
        out = {}
        for h in sorted(terms(t) & set(parts)):
            for k in parts[h]:
                out[k] = spark_hash(out.get(k, k), h)
        return {k: h & 0xFFFFFF for k, h in out.items()}

    def shown(sig, t):
        whole = "=%016x" % (spark_hash(t) & (1 << 64) - 1)
        return "".join("%06x" % sig[k] if k in sig else "------" for k in range(I.SUBSETS)) if sig else whole

    def likeness(a, b, s, t):
        used = set(a) | set(b)
        return sum(a.get(k) == b.get(k) for k in used) / len(used) if used else float(s == t)

    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = signature(t), signature(edited), signature(after)
        assert (got.fingerprint[i], got.edited_fingerprint[i]) == (shown(a, t), shown(e, edited))
        assert got.near_edited[i] == pytest.approx(likeness(a, e, t, edited))
        assert got.near_next[i] == pytest.approx(likeness(a, n, t, after))


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    got = table(I.op10_imatch(spark, SF)).set_index("doc_id")
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {i: (got.n_chars[i], got.edited_sha256[i]) for i in got.index} == plain(rows)
    brute(rows, got)


def test_blocks_of_three_levels(spark, monkeypatch):
    monkeypatch.setattr(I, "_CHUNK", 3)
    splits = list(range(0, 200, 7))
    block, is_split = I._block(I.F.col("i"), splits)
    ids = spark.createDataFrame([(i,) for i in range(-3, 210)] + [(None,)], "i long")
    for r in ids.select("i", block.alias("b"), is_split.alias("s")).collect():
        assert (r.b, r.s) == ((0, False) if r.i is None else (sum(s < r.i for s in splits), r.i in splits))


def test_edges(spark):
    got = table(I.fingerprint_pairs(edges(spark)))
    assert len(got) == 13 and got.near_next.notna().all() and got.near_edited.between(0, 1).all()
    same = got[got.doc_id.isin([5, 6])]
    assert same.fingerprint.nunique() == 1
    assert table(I.fingerprint_pairs(docs(spark, []))).empty
    alone = table(I.fingerprint_pairs(docs(spark, [(1, "abcdef")])))
    assert alone.edited_sha256.iloc[0] == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next.iloc[0] == 1
