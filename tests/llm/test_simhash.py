import numpy as np
import pytest
import xxhash

from rarefy.llm import simhash as S
from rarefy.llm.components import connected_components

from .helpers import HAVE, SF, docs, edges, table


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps):
    """Brute force over all pairs; the smallest id that is reachable."""
    fps = np.array(fps, "<u8")
    label = np.arange(len(fps))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    while changed:
        new = np.array([label[n].min() for n in near])
        new = np.minimum(new, label)
        changed = (new != label).any()
        label = new
    low = {}
    for i, c in zip(ids, label):
        low[c] = min(low.get(c, i), i)
    return [low[c] for c in label]


def cloud(rng, n):
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, n).astype("<u8")
    near = base[rng.integers(0, 3, n)] ^ bit() ^ bit() ^ bit()
    return np.unique(np.concatenate([near, rng.integers(0, 2**63, n, dtype=np.uint64)]))


@pytest.mark.parametrize("n", [40, 1500])
def test_run_against_all_pairs(rng, n):
    fps = cloud(rng, n)
    fps = fps[np.argsort(S.gray_rank(fps))]
    label = S.link_run(fps)
    expected = components(range(len(fps)), fps)
    assert len(set(zip(label, expected))) == len(set(label)) == len(set(expected))


def test_gray_neighbours_differ_by_one_bit():
    codes = np.arange(256, dtype="<u8")
    order = codes[np.argsort(S.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("run_rows", [4, 1 << 16])
def test_links_whatever_the_run_size(spark, rng, run_rows):
    fps = cloud(rng, 150)
    edges_ = S.link_edges(spark.createDataFrame([(int(f),) for f in fps.view("<i8")], "fp long"), run_rows=run_rows)
    roots = {r.node: r.root for r in connected_components(edges_).collect()}
    got = [roots.get(int(f), int(f)) for f in fps.view("<i8")]
    expected = components(range(len(fps)), fps)
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and all(roots[100 + i] == 100 for i in range(1, 50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    got = table(S.op1_simhash(spark, SF))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        assert int(r.fingerprint, 16) == plain(texts[r.doc_id]) and len(r.fingerprint) == 16
    assert list(got.component_id) == components(list(got.doc_id), [int(f, 16) for f in got.fingerprint])


def test_edges(spark):
    got = table(S.near_duplicates(edges(spark)))
    assert len(got) == 13
    zero = got[got.fingerprint == "0" * 16]
    assert set(zero.doc_id) == {1, 2, 3} and set(zero.component_id) == {1}
    assert set(got[got.doc_id.isin([5, 6])].component_id) == {5}
    assert table(S.near_duplicates(docs(spark, []))).empty
    kept = S.keep_one(edges(spark))
    assert kept.columns == edges(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 7, 8, 9, 10]


def test_rows_without_id_take_part(spark):
    text = "the same long words in every copy of this text, over and over again"
    given = docs(spark, [(None, text), (7, text), (None, "no twin of this one has an id"), (None, "no twin of this one has an id"), (8, "alone here"), (8, "alone here")])
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in S.keep_one(given).collect())
    assert kept == [(-1, "no twin of this one has an id"), (7, text), (8, "alone here")]
