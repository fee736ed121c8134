import hashlib

import numpy as np
import pytest

from rarefy.llm import suffixes as X

from .helpers import HAVE, SF, docs, edges, table


def plain(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all strings."""
    first = {}
    for k, b in sorted(rows, key=lambda r: r[0]):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], k)
    out = {}
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(got, rows, length=50):
    expected = plain(rows, length)
    assert sorted(got.doc_id) == sorted(expected)
    for r in got.itertuples():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


@pytest.mark.parametrize("letters", [1, 2, 30, 250])
def test_two_stage_order(rng, letters):
    for n in (1, 2, 17, 400):
        t = np.r_[rng.integers(1, letters + 1, n), 0].astype(np.uint16)
        t[n // 2] = 0
        order, common = X.suffix_array(t, 20)
        keys = [tuple(t[i : i + 20]) + (0,) * (20 - len(t[i : i + 20])) for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
        for a, b, c in zip(keys, keys[1:], common[1:]):
            assert c == next((i for i in range(20) if a[i] != b[i]), 20)
        wanted = rng.random(len(t)) < 0.3
        some, _ = X.suffix_array(t, 20, wanted)
        assert [keys[list(order).index(i)] for i in some] == sorted(k for i, k in zip(order, keys) if wanted[i])


def test_every_string_has_an_anchor(rng):
    data = bytes(rng.integers(97, 100, 4000, dtype=np.uint8))
    at, _ = X.anchors(data)
    assert at[0] <= 34 and at[-1] >= len(data) - 50 and np.diff(at).max() <= 35
    other, _ = X.anchors(b"??" + data[1000:1200])
    assert set(at[(at >= 1000) & (at < 1150)][1:-1] - 998) <= set(other)


def test_blocks_of_texts(rng, monkeypatch):
    """Texts of a block have the anchors and keys that each has alone, and small texts share numpy's calls."""
    rows = [(i, 7 * i, bytes(rng.integers(97, 123, int(n), dtype=np.uint8))) for i, n in enumerate(rng.integers(0, 300, 400))]
    rows += [(400, 1, rows[5][2] + rows[6][2] + rows[7][2]), (401, 1, b"a" * 90), (399, 5, b"b" + rows[9][2])]
    batch = X.pa.RecordBatch.from_arrays([X.pa.array(c, t) for c, t in zip(zip(*rows), (X.pa.int64(), X.pa.int64(), X.pa.binary()))], ["k", "th", "t"])
    calls = []
    plain_hash = X._hashed
    monkeypatch.setattr(X, "_hashed", lambda *a: calls.append(len(a[1])) or plain_hash(*a))
    dealt = [b for b in X._deal(4, 50)([batch])]
    assert len(calls) < 40  # three for each text before
    sides, again = [], []
    for bucket, ids, hashes in zip(*(c.to_pylist() for b in dealt for c in b.columns)):
        k, th, code = X._unpack(ids, "<i8", "<i8", "<u4")
        (sides if bucket >= 0 else again).extend(zip(np.cumsum(k).tolist(), th.tolist(), code.tolist(), X._unpack(hashes, "<u8")[0].tolist() if bucket >= 0 else code.tolist()))
    expected = {}
    for k, th, data in rows:
        for at in X.anchors(data)[0].tolist():
            for side, lo, hi, salt in ((0, at - 17, at + 16, 0), (1, at, at + 34, 1)):
                if lo >= 0 and hi <= len(data):
                    expected[k, th, 2 * at + side] = int(plain_hash(data[lo:hi] + bytes(15), np.array([0]), hi - lo, salt)[0]) | 1
    owners = {}
    for (k, _, _), key in expected.items():
        owners.setdefault(key, set()).add(k)
    shared = {x for x, key in expected.items() if len(owners[key]) > 1}
    assert shared and {x[:3] for x in again} == shared
    alone = {x[:3]: x[3] for x in sides if x[2] != X._NO_CODE}
    assert alone == {x: key for x, key in expected.items() if x not in shared}
    loads = {x[3]: x[1] for x in sides if x[2] == X._NO_CODE}
    assert set(loads) == {expected[x] for x in shared} and set(loads.values()) == {1, 2}
    # the size of a block changes nothing
    for size in (1, 700):
        monkeypatch.setattr(X, "BLOCK_BYTES", size)
        assert [b for b in X._deal(4, 50)([batch])] == dealt
    # fragments are cut block by block too
    codes = [np.array([x[2] for x in sorted(shared) if x[:2] == r[:2]], "<u4").tobytes() for r in rows]
    batch = X.pa.RecordBatch.from_arrays([*batch.columns, X.pa.array(codes, X.pa.binary())], ["k", "th", "t", "entries"])
    found = []
    for size in (1, 700, 1 << 16):
        monkeypatch.setattr(X, "BLOCK_BYTES", size)
        calls.clear()
        found.append(list(X._cut(4, 50, np.empty(0, "<u8"))([batch])))
    assert found[0] == found[1] == found[2] and len(calls) < 10


def texts(rng, n=60):
    """Copies, near copies, shared passages at any place, runs of one letter."""
    letters = "abcdefghij  \n"
    word = lambda k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    passages = [word(int(k)) for k in rng.integers(45, 160, 6)] + ["a" * 70, "é" * 40]
    out = []
    for _ in range(n):
        parts = [word(int(rng.integers(0, 90)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[rng.integers(len(passages))], word(int(rng.integers(0, 60)))]
        t = "".join(parts)
        if out and rng.random() < 0.3:
            t = out[rng.integers(len(out))]
            if rng.random() < 0.6 and t:
                k = int(rng.integers(len(t)))
                t = t[:k] + "Z" + t[k + 1 :]
        out.append(t)
    return out


@pytest.mark.parametrize("chunk, fragments, sort, bucket", [(40, 50, 1 << 14, 1 << 25), (1 << 20, 1 << 17, 1 << 14, 300), (1 << 20, 1 << 17, 5, 1 << 25)])
def test_against_all_strings(spark, rng, monkeypatch, chunk, fragments, sort, bucket):
    monkeypatch.setattr(X, "CHUNK_ANCHORS", chunk)
    monkeypatch.setattr(X, "CHUNK_FRAGMENTS", fragments)
    monkeypatch.setattr(X, "SORT_FRAGMENTS", sort)
    monkeypatch.setattr(X, "BUCKET_BYTES", bucket)
    rows = list(enumerate(texts(rng)))
    got = table(X.remove_repeats(docs(spark, rows).repartition(3)))
    check(got, [(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("length", [24, 25, 64])
def test_other_lengths(spark, rng, length):
    rows = list(enumerate(texts(rng, 30)))
    check(table(X.remove_repeats(docs(spark, rows).repartition(2), length)), [(i, t.encode()) for i, t in rows], length)


def test_equal_hashes_decide_nothing(spark, rng, monkeypatch):
    """With hashes that nearly all collide the result is the same: bytes decide."""
    plain_hash = X._hashed
    monkeypatch.setattr(X, "_hashed", lambda *a: plain_hash(*a) & np.uint64(3 << 20))
    rows = [t.encode() for t in texts(rng, 25)]
    dealt = [(i, i, data, np.sort(np.r_[X.anchors(data)[0] * 2, X.anchors(data)[0] * 2 + 1]).astype("<u4")) for i, data in enumerate(rows) if len(data) >= 50]
    batch = X.pa.RecordBatch.from_arrays([X.pa.array(c, t) for c, t in zip(zip(*((k, th, d, c.tobytes()) for k, th, d, c in dealt)), (X.pa.int64(), X.pa.int64(), X.pa.binary(), X.pa.binary()))], ["k", "th", "t", "entries"])
    cut = list(X._cut(2, 50, np.empty(0, "<u8"))([batch]))
    cut = X.pa.Table.from_batches(cut).sort_by("bucket").to_batches()
    found = [b for b in X._compare(50, 1)(cut)]
    spans = {}
    for b in X._gather(X._SPAN)(found):
        spans |= dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
    expected = plain(list(enumerate(rows)))
    for i, data in enumerate(rows):
        gone = int(X._removed(spans[i], len(data)).sum()) if i in spans else 0
        assert gone == expected[i][1]


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(table(X.op3_suffixes(spark, SF)), rows)


def test_edges(spark):
    got = table(X.remove_repeats(edges(spark), text=True))
    assert len(got) == 13
    assert got[got.doc_id.isin([1, 2])].n_bytes.tolist() == [0, 0]
    assert (got[got.doc_id != 8].n_removed == 0).all()  # under 50 bytes, or without a twin
    assert got[got.doc_id == 8].n_removed.tolist() == [0]  # repeats within one document stay
    assert bytes(got[got.doc_id == 4].kept.iloc[0]) == b"one"
    long = "a passage of more than fifty bytes that two documents have in common"
    got = table(X.remove_repeats(docs(spark, [(None, long), (1, long), (1, long), (2, "x" + long)])))
    assert sorted(zip(got.doc_id.fillna(-1), got.n_removed)) == [(-1, len(long)), (1, 0), (1, 0), (2, len(long))]
    assert table(X.remove_repeats(docs(spark, []))).empty


def test_hot_keys_change_nothing(spark, rng, monkeypatch):
    """A passage between different neighbours, with its edges dealt string by string."""
    letters = [chr(c) for c in range(97, 123)]
    word = lambda k: "".join(letters[i] for i in rng.integers(0, 26, k))
    passage = word(90)
    rows = [(i, word(int(rng.integers(0, 60))) + passage + word(int(rng.integers(0, 60)))) for i in range(30)]
    rows += [(100 + i, t) for i, t in enumerate(texts(rng, 30))]
    df = docs(spark, rows).repartition(3)
    seen = []
    monkeypatch.setattr(X, "HOT_FRAGMENTS", 3)
    cut = X._cut
    monkeypatch.setattr(X, "_cut", lambda buckets, length, hot, *turn: seen.append(len(hot)) or cut(buckets, length, hot, *turn))
    check(table(X.remove_repeats(df)), [(i, t.encode()) for i, t in rows])
    assert seen[0] > 10
    # beyond the list of hot keys, large groups are taken apart where they are sorted
    monkeypatch.setattr(X, "HOT_KEYS", 1)
    monkeypatch.setattr(X, "SORT_FRAGMENTS", 2)
    monkeypatch.setattr(X, "TURNS", 3)
    check(table(X.remove_repeats(df)), [(i, t.encode()) for i, t in rows])
