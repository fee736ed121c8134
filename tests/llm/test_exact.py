import duckdb
import pytest

from rarefy.llm import exact as E
from rarefy.llm._shared import scratch_tables

from .helpers import HAVE, SF, docs, edges, table


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, expected = table(E.op8_exact_dedup(spark, SF)), con.execute(E.OP8_SQL).df()
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got, expected = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, expected))
    assert got.equals(expected.astype(got.dtypes))


def test_batches(spark):
    index = E.open_index(spark, buckets=3)
    first = table(E.deduplicate(docs(spark, [(1, "a"), (2, "a"), (3, "b")]), index)).set_index("doc_id")
    assert first.kept.to_dict() == {1: False, 2: True, 3: True}
    again = E.open_index(spark, index.name, index.path, 3)  # the same files
    second = table(E.deduplicate(docs(spark, [(9, "a"), (10, "c")]), again)).set_index("doc_id")
    assert second.kept.to_dict() == {9: False, 10: True} and second.keep_id[9] == 2
    assert index.rows().count() == 3
    plan = docs(spark, [(1, "a")]).select(E.digest().alias("digest")).groupBy("digest").count().hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_edges(spark):
    got = table(E.deduplicate(edges(spark), E.open_index(spark)))
    assert len(got) == 13
    empty = got[got.doc_id.isin([1, 2])]
    assert empty.keep_id.tolist() == [2, 2] and empty.group_size.tolist() == [2, 2]
    same = got[got.group_size == 4]
    assert sorted(same.doc_id.fillna(-1)) == [-1, 5, 6, 6] and set(same.keep_id) == {6}
    assert got[got.doc_id.isna() & (got.group_size == 1)].kept.all()
    assert table(E.deduplicate(docs(spark, []), E.open_index(spark))).empty
    kept = E.keep_one(edges(spark))
    assert kept.columns == edges(spark).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 2, 3, 4, 6, 6, 7, 8, 9, 10]


def test_keep_one_judges_an_id_with_its_text(spark):
    kept = E.keep_one(docs(spark, [(5, "a"), (5, "b"), (9, "b"), (7, "c"), (7, "c")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "a"), (7, "c"), (7, "c"), (9, "b")]


def test_sizes_of_later_batches(spark):
    index = E.open_index(spark)
    table(E.deduplicate(docs(spark, [(1, "a"), (2, "a"), (9, "c")]), index))
    got = table(E.deduplicate(docs(spark, [(3, "a"), (4, "a"), (5, "a"), (6, "b")]), index)).set_index("doc_id")
    assert got.group_size.to_dict() == {3: 3, 4: 3, 5: 3, 6: 1}
    assert got.keep_id.to_dict() == {3: 2, 4: 2, 5: 2, 6: 6} and got.kept.to_dict() == {3: False, 4: False, 5: False, 6: True}


def test_scratch_tables_go(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with scratch_tables():
        assert E.keep_one(docs(spark, [(1, "a"), (2, "a")])).count() == 1
        assert {t.name for t in spark.catalog.listTables()} != before
    assert {t.name for t in spark.catalog.listTables()} == before
