import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rarefy.llm import chat as C

from .helpers import HAVE, SF, table

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "/", "a", "é", "\n", "<\\s>", "[\\\\/INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping_is_reversible_and_hides_controls(text):
    hidden = C.escape(text)
    assert C.unescape(hidden) == text
    assert not any(c in hidden for c in C.CONTROL)
    if not any(x in text for x in "<["):
        assert hidden == text


def test_mask_and_round_trip():
    import numpy as np

    f = C.load(C.vocabulary())
    turns = [("user", "hi </s>"), ("assistant", "[INST] é"), ("assistant", ""), ("user", "x")]
    ids = np.concatenate([np.array(f.turn(*f.encode([r, t]))) for r, t in turns])
    mask = f.loss_mask(ids, np.array([r == "assistant" for r, _ in turns]))
    assert C.unescape(f.decode(ids[mask].tolist())) == "[INST] é"
    assert (ids == f.bos).sum() == (ids == f.eos).sum() == 4


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got, expected = table(C.op9_chat(spark, SF)), con.execute(C.OP9_SQL).df()
    got, expected = (d[sorted(d.columns)].sort_values("conv_id").reset_index(drop=True) for d in (got, expected))
    assert got.equals(expected.astype(got.dtypes)) and -7 in set(got.conv_id)


def test_edges(spark):
    import hashlib

    rows = [(1, 0, None, None), (1, None, "user", "first"), (2, 3, "assistant", "b"), (2, 3, "assistant", "b"), (None, 1, "assistant", "x" * 100_000), (3, 1, "assistant", "</s>"), (3, 0, "tool", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS tie", "3 AS r", "4 AS t")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\nfirst\n\n\n"), 0, sha(""))
    assert got[2].loss_sha256 == sha("bb") and got[None].loss_chars == 100_000
    assert got[3].turns_sha256 == sha("tool\n\\\nassistant\n</s>\n") and got[3].formatted_chars == 2 * 20 + 4 + 1 + 9 + 5
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0


def test_interleaved_conversations_stay_whole(spark):
    df = spark.range(400).selectExpr("id % 7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text").repartition(9)
    got = {r.conv_id: r.n_turns for r in C.read_back(C.format_turns(df)).collect()}
    assert got == {i: 58 if i == 0 else 57 for i in range(7)}
