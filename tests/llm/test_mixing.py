import duckdb
import pytest

from rarefy.llm import mixing as M

from .helpers import HAVE, SCHEMA, SF, docs, edges, table


def water_level(sizes, weights, share=1.5, epochs=2):
    """Targets by repeated resharing of what exceeds a source's cap."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = epochs * sizes[i]
            open_.remove(i)
        left = total - sum(target)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 3, 50, 0, 7, 9], [5], [0, 0], [10**9, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = [(i == len(sizes) - 1, f"s{i:03}", n) for i, n in enumerate(sizes)]
    got = M.targets(spark.createDataFrame(rows, "no_source boolean, name string, source_size long")).orderBy("name").collect()
    expected = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [r.target for r in got] == pytest.approx(expected)


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, expected = table(M.op5_mixing(spark, SF)), con.execute(M.OP5_SQL).df()
    order = ["doc_id"]
    got, expected = (d[sorted(d.columns)].sort_values(order).reset_index(drop=True) for d in (got, expected))
    assert got.equals(expected.astype(got.dtypes))
    assert (got.taken <= 2 * got["size"]).all()


def test_ranges_do_not_matter(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 40)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) AS source")
    whole = table(M.mix(rows)).sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    assert table(M.mix(rows.repartition(7))).sort_values("doc_id").reset_index(drop=True).equals(whole)
    per_source = whole.assign(s=[("hot" if i % 3 == 0 else f"s{i % 11}") for i in whole.doc_id]).groupby("s").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per_source.taken - per_source.target) <= 0.5).all()


def test_edges(spark):
    got = table(M.mix(edges(spark)))
    assert len(got) == 13 and (got["size"] >= 0).all() and (got.taken <= 2 * got["size"]).all()
    assert (got[got["size"] == 0].taken == 0).all()
    assert table(M.mix(docs(spark, []))).empty
    mixed = M.apply_mix(edges(spark))
    assert mixed.columns == edges(spark).columns and mixed.count() > 0


def test_rows_without_id_come_out_as_taken(spark):
    rows = [(None, f"only text {i} " + "w " * (i % 5), None, "no-ids", None) for i in range(40)]
    rows += [(i if i % 2 else None, f"part {i} of this " + "w " * (i % 7), None, "some-ids", None) for i in range(60)]
    rows += [(1000 + i % 20, f"again {i % 20}", None, "repeated", None) for i in range(60)]
    given = spark.createDataFrame(rows, SCHEMA)
    # which source a row of mix() has shows in source_size
    mixed = table(M.mix(given))
    copies = (-(-mixed.taken // mixed["size"].clip(lower=1))).groupby([mixed.source_size, mixed.doc_id.isna()]).sum()
    out = table(M.apply_mix(given)).assign(n=1)
    words = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("no-ids", "some-ids", "repeated")}
    assert len(set(words.values())) == 3
    got = out.n.groupby([out.source.map(words), out.doc_id.isna()]).sum()
    assert got.to_dict() == {k: v for k, v in copies.items() if v}
    assert (out.source == "no-ids").any()
