import zlib

import numpy as np
import pytest

from rarefy.llm import language as L

from .helpers import HAVE, docs, edges, table

SF = "/root/testdata/sf0.01"


def test_ngrams_and_bundles():
    codes, counts = L.letter_ngrams("Ab, ab!")
    shown = {"".join(chr(int(c) >> 21 * k & 0x1FFFFF) for k in (2, 1, 0)): int(n) for c, n in zip(codes, counts)}
    assert shown == {" ab": 2, "ab ": 2, "b a": 1}
    v = L.Vectors(64)
    bound = np.prod([np.roll(v.letter(ord(c), 0), 2 - i) for i, c in enumerate(" ab")], axis=0)
    at = np.flatnonzero(codes == (ord(" ") << 42 | ord("a") << 21 | ord("b")))[0]
    assert (v.rows[v.index(codes)][at] == bound).all()
    total = sum(n * v.rows[v.index(codes)][i] for i, n in enumerate(counts))
    assert np.allclose(v.bundle(codes, counts), total)


def test_vectors_are_bounded_and_repeatable(monkeypatch):
    monkeypatch.setattr(L, "KEPT_VECTORS", 64)
    v, w = L.Vectors(32), L.Vectors(32)
    texts = ["".join(chr(0x4E00 + (7 * i + j) % 900) for j in range(40)) for i in range(20)]
    first = [v.bundle(*L.letter_ngrams(t)) for t in texts]
    assert len(v.codes) <= 64
    assert np.allclose(first[3], w.bundle(*L.letter_ngrams(texts[3])))


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_held_out_accuracy(spark):
    got = table(L.op2_language(spark, SF))
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and both.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98


def test_edges(spark):
    train = [(100 + i, t, lang, None, None) for i, (t, lang) in enumerate([("the quick words", "en"), ("die schnellen wörter", "de"), ("x", None)] * 8)]
    model = L.learn(spark.createDataFrame(train, edges(spark, False).schema))
    assert model[0] == ["de", "en"]
    got = table(L.identify(edges(spark), *model))
    assert len(got) == 13
    assert set(got[got.doc_id.isin([1, 2, 3, 9])].lang_pred) == {"und"}
    assert (got[got.lang_pred == "und"].score == 0).all()
    none = L.learn(docs(spark, []))
    assert none[0] == [] and set(table(L.identify(edges(spark), *none)).lang_pred) == {"und"}
    assert table(L.identify(docs(spark, []), *model)).empty
    kept = L.accept(edges(spark))
    assert kept.columns == edges(spark).columns
    assert not {1, 2, 3, 9} & {r.doc_id for r in kept.collect()}


def test_accept_drops_what_op2_calls_und(spark):
    train = [(4 * i, t, lang, None, None) for i, (t, lang) in enumerate([("the quick words", "en"), ("die schnellen wörter", "de")] * 8)]
    words = ["".join(chr(first + (7 * i + 5 * j) % 24) for j in range(5)) for first in (0x3B1, 0x430, 0x4E00) for i in range(20)]
    given = spark.createDataFrame(train + [(1000 + i, w, None, None, None) for i, w in enumerate(words + ["12 !", "", None])], edges(spark, False).schema)
    scored = table(L.identify_blocks(given, L.learn_split(given)))
    assert (scored.score == 0).sum() > 3  # a cosine of zero or less isn't und
    assert sorted(r.doc_id for r in L.accept(given).collect()) == sorted(scored[scored.lang_pred != "und"].doc_id)


def brute(rows, seed=L.SEED):
    """doc_id -> (lang, score) in plain Python: every n-gram vector from its letters, every cosine."""
    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = 2.0 * np.random.default_rng((seed, c)).integers(0, 2, L.DIMS, dtype=np.int8) - 1
        return letters[c]

    grams = {}

    def bundle(text):
        shown = "".join(c if c.isalpha() else " " for c in text.lower())
        if not shown.strip():
            return None
        shown = " " + " ".join(shown.split()) + " "
        v = np.zeros(L.DIMS)
        for g in (shown[i : i + 3] for i in range(len(shown) - 2)):
            if g not in grams:
                grams[g] = np.roll(letter(ord(g[0])), 2) * np.roll(letter(ord(g[1])), 1) * letter(ord(g[2]))
            v += grams[g]
        return v

    own = {i: bundle(t or "") for i, t, _ in rows}
    profiles = {}
    for i, _, lang in rows:
        if lang is not None and own[i] is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            profiles[lang] = profiles.get(lang, 0) + own[i]
    out = {}
    for i, _, _ in rows:
        cos = {lang: own[i] @ p / np.linalg.norm(own[i]) / np.linalg.norm(p) for lang, p in profiles.items()} if own[i] is not None else {}
        best = max(sorted(cos), key=cos.get, default="und")
        out[i] = best, max(0.0, cos.get(best, 0.0)), cos
    return out


@pytest.mark.parametrize("rows_at_once", [2, 4096])
@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query_against_brute_force(spark, monkeypatch, rows_at_once):
    """Every row of the query; with blocks of two languages, too."""
    monkeypatch.setattr(L, "LANGUAGE_ROWS", rows_at_once)
    small = SF.replace("0.01", "0.001")
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    expected = brute(rows)
    got = table(L.op2_language(spark, small))
    assert sorted(got.doc_id) == sorted(expected)
    for r in got.itertuples():
        lang, score, cos = expected[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-4)
        assert r.lang_pred == lang or abs(cos[r.lang_pred] - cos[lang]) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_texts_that_are_not_utf8(spark):
    rows = spark.createDataFrame([(4 * i, t, lang, None, None) for i, (t, lang) in enumerate([("the quick words", "en"), ("die wörter", "de")] * 4)], edges(spark, False).schema)
    odd = rows.limit(1).selectExpr("-1L AS doc_id", "cast(X'61FF62' AS string) AS text", "cast(X'FF' AS string) AS lang", "source", "n_chars")
    only = odd.selectExpr("-2L AS doc_id", "cast(X'FFFE' AS string) AS text", "lang", "source", "n_chars")
    given = rows.union(odd).union(only)
    got = table(L.identify_blocks(given, L.learn_split(given))).set_index("doc_id")
    assert got.lang_pred[-2] == "und" and got.lang_pred[-1] != "und"
    assert sorted(r.doc_id for r in L.accept(given).select("doc_id").collect()) == sorted([-1, *range(0, 32, 4)])
