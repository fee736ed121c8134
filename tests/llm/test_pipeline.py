import hashlib

import numpy as np
import pytest

import corpus_pipeline
from rarefy.llm import bpe, mixing

from rarefy.llm._shared import scratch_tables

from .helpers import HAVE, SF, edges
from .test_simhash import components, plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_run_against_brute_force(spark, tmp_path):
    import tiktoken
    import public_tokenizers

    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    rows = [r for r in rows if last[r["text"]] == r["doc_id"]]
    named = components([r["doc_id"] for r in rows], [plain(r["text"]) for r in rows])
    rows = [r for r, c in zip(rows, named) if r["doc_id"] == c]
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    expected = []
    for r in rows:
        size, words = taken[r["doc_id"]]
        ids = np.array(encoding.encode_ordinary(r["text"]), "<u4")
        expected += [(r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] * -(-words // max(size, 1))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == sorted(expected)


def test_stages_keep_columns_and_take_empty_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "encode"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == COLUMNS, name
        assert stage(spark, docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()] == [f"op{i}" for i in range(1, 11)]


def test_stages_define_every_edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names: none is lost but by a verdict."""
    given = edges(spark)
    docs = given
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with scratch_tables():
            rows = [r.asDict() for r in stage(spark, docs, SF).collect()]
        assert rows and list(rows[0]) == given.columns, name
        docs = spark.createDataFrame([tuple(r.values()) for r in rows], given.schema)
        sizes.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows))
    lettered = [(False, 4), (False, 5), (False, 6), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0), (True, 0)]
    assert sizes[0] == lettered
    # of four copies the rows of the largest id stay, both of them; then one of these
    assert sizes[1] == [(False, 4), (False, 6), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)]
    assert sizes[2] == [(False, 4), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == len(sizes[3])
