"""Every registered tensor query against its SQL, on small tables; and that none is empty on larger ones."""

import os

import duckdb
import pytest

from rarefy.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert len(got) == len(expected) > 0
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ["any_axis", "hits", "hits_step", "triangles", "sddmm", "nansum"])
def test_not_empty_on_larger_tables(spark, name):
    rows = QUERIES[name](spark, SF.replace("0.001", "0.01")).collect()
    assert rows and any(any(v for k, v in r.asDict().items() if k not in ("d0", "d1")) for r in rows)


def _agrees(spark, name, path, **tables):
    """The query against its SQL over small tables of its own, written to path; nation comes from the test tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    got, expected = QUERIES[name](spark, str(path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_einsum_counts_stored_zeros(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (range % 3) DAY AS ts, range % 4 AS user_id, 'click' AS event_type, (range % 3) / 2.0::DOUBLE AS value FROM range(24)"
    _agrees(spark, "einsum", tmp_path, events=events)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_windows(spark, tmp_path):
    from rarefy.streaming import accumulate, read_cells

    path = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS t, id % 3 AS i, 1L AS v FROM range(180)").write.parquet(path)
    cells = read_cells(spark, path, "t timestamp, i long, v long")
    run = accumulate(cells, ["i"], "v", time="t", window="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.start.hour, r.d0, r.v) for r in spark.table("windows").collect()} == {(h, i, 20) for h in range(3) for i in range(3)}
