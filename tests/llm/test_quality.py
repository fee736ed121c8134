import zlib

import numpy as np
import pytest

from rarefy.llm import quality as Q

from .helpers import HAVE, docs, edges, table

SF = "/root/testdata/sf0.01"


def test_logistic_and_calibration(rng):
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    m = Q.Logistic().fit(x, y)
    assert ((m.odds(x) > 0) == y).mean() > 0.9
    cal = Q.Platt().fit(10 * m.odds(x), y)
    p = 1 / (1 + np.exp(-cal(10 * m.odds(x))))
    for low in (0.2, 0.6):
        part = (p > low) & (p < low + 0.3)
        assert not part.any() or abs(p[part].mean() - y[part].mean()) < 0.3


def surest_in(a, b):
    """The selection of a round over whole matrices: plain numpy."""
    free = np.ones(len(a), bool)

    def surest(models, gates):
        out, gone = [], []
        least = np.log(Q.SURE / (1 - Q.SURE))
        for k, (m, gate) in enumerate(zip(models, gates)):
            odds = gate(m.odds((a, b)[k])) if len(a) else np.zeros(0)
            picked = []
            for sign in (1, -1):
                hit = np.flatnonzero(free & (sign * odds > least))
                picked.append(hit[np.argsort(-np.abs(odds[hit]), kind="stable")][: Q.HANDED])
            p = np.concatenate(picked)
            gone.append(p)
            out.append((a[p], b[p], (odds[p] > 0).astype(float)))
        free[np.concatenate(gone)] = False
        return out

    return surest


def test_views_teach_each_other(rng):
    """Few labels that only one view understands: the other learns from what it hands over."""
    n = 3000
    y = (rng.random(n) < 0.5).astype(float)
    a = np.c_[y * 4 - 2 + rng.normal(size=n), rng.normal(size=(n, 3))]
    b = np.c_[rng.normal(size=(n, 30)), y[:, None] * 2 - 1 + rng.normal(size=(n, 2))]
    few = slice(0, 120)
    alone = Q.CoTrained(0.5).fit([a[few], b[few]], y[few], None, rounds=0)
    both = Q.CoTrained(0.5).fit([a[few], b[few]], y[few], surest_in(a[120:], b[120:]))
    right = lambda m: ((m.score([a, b])[2] > 0.5) == y).mean()
    assert right(both) > right(alone)
    assert ((both.score([a, b])[0] > 0.5) == y).mean() > 0.9


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query_against_brute_force(spark, monkeypatch):
    """Every row of the query, from views, selection and rounds on one machine."""
    small = SF.replace("0.01", "0.001")
    monkeypatch.setattr(Q, "HANDED", 7)
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    enc = lambda s: None if s is None else s.encode()
    t = np.stack([Q.text_view((r.text or "").encode()) for r in rows]).astype("<f4").astype(float)
    m = np.stack([Q.meta_view(enc(r.source), enc(r.lang), r.n_chars) for r in rows]).astype("<f4").astype(float)
    have = sorted((i for i, r in enumerate(rows) if r.doc_id in labels), key=lambda i: zlib.crc32(b"%d" % rows[i].doc_id))
    rest = [i for i, r in enumerate(rows) if r.doc_id not in labels]
    y = np.array([float(labels[rows[i].doc_id]) for i in have])
    model = Q.CoTrained(float(y.mean())).fit([t[have], m[have]], y, surest_in(t[rest], m[rest]))
    score, text, meta = model.score([t, m])
    got = table(Q.op7_quality(spark, small)).set_index("doc_id")
    assert len(got) == len(rows)
    for r, *expected in zip(rows, score, text, meta):
        assert np.allclose(got.loc[r.doc_id, ["score", "text_score", "meta_score"]].astype(float), expected, atol=1e-7)
        assert got.kept[r.doc_id] == (expected[0] >= Q.KEEP) or abs(expected[0] - Q.KEEP) < 1e-7


def test_labels_of_other_documents_and_repeated_ids(spark):
    rows = [(i % 40, ("good words here " if i % 2 else "$$$ !!! ") * (1 + i % 7), None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(i, 1, 0) for i in range(1000, 9000)], "doc_id long, quality int, toxic int")
    seen = Q.views(docs(spark, [(r[0], r[1]) for r in rows]))
    model = Q.train(seen, labels, labelled=20)
    assert model.models
    got = table(Q.classify(seen, model))
    assert len(got) == 400 and (got.kept == (got.doc_id % 2 == 1)).mean() > 0.9  # of 20 labels, ten train


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_held_out_accuracy(spark):
    got = table(Q.op7_quality(spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    both = got.merge(labels, on="doc_id")
    both = both[[zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]]
    assert ((both.kept) == (both.quality == 1)).mean() > 0.93
    assert both[both.quality == 1].kept.mean() > 0.97


def test_edges(spark):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (5, 1, 0), (5, 0, 0), (7, None, 0), (8, 3, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = edges(spark)
    seen = Q.views(df)
    got = table(Q.classify(seen, Q.train(seen, labels)))
    assert len(got) == 13 and got.score.between(0, 1).all() and got.score.notna().all()
    none = Q.views(docs(spark, []))
    assert table(Q.classify(none, Q.train(none, labels))).empty
    assert table(Q.classify(seen, Q.train(seen, labels.limit(0)))).kept.all()
    odd = df.limit(2).selectExpr("doc_id", "text", "cast(X'FF' AS string) AS lang", "cast(X'C3' AS string) AS source", "n_chars")
    assert len(table(Q.classify(Q.views(odd), Q.train(seen, labels)))) == 2
