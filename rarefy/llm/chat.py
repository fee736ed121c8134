r"""Chat formatting by token-level assembly.

A turn becomes ``<s>[INST]role[/INST]text</s>``. The four control strings are single reserved ids
above the vocabulary, spliced between separately encoded segments, so no merge crosses a border
and no text can produce one. In role and text, a control string gets a backslash after its
first character (``<\/s>``), and one more where it has some already: other text stays as it is,
and taking one backslash away again gives back every text.

The loss mask comes from prefix sums over the ids: tokens are inside a text where more ``[/INST]``
than ``</s>`` have been seen, and count where the turn (the number of ``<s>`` seen) is the assistant's.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, raw
from .bpe import byte_table

VOCABULARY = "byte_bpe_50k.json"
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
ASSISTANT = "assistant"
_ESCAPE = re.compile(r"(?:(?<=<)(?=\\*/?s>))|(?:(?<=\[)(?=\\*/?INST\]))")
_UNESCAPE = re.compile(r"(?:(?<=<)\\(?=\\*/?s>))|(?:(?<=\[)\\(?=\\*/?INST\]))")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


class Formatter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bos, self.inst, self.end_inst, self.eos = range(size, size + len(CONTROL))
        back = {c: b for b, c in enumerate(byte_table())}
        self.parts = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # added tokens are plain text in the vocabulary; ordinary ones use the byte table
            known = all(c in back for c in token)
            self.parts[i] = bytes(back[c] for c in token) if known else token.encode()
        self.control_chars = sum(map(len, CONTROL))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]

    def turn(self, role: list[int], text: list[int]) -> list[int]:
        return [self.bos, self.inst, *role, self.end_inst, *text, self.eos]

    def decode(self, ids) -> str:
        """The escaped text of ids without control ids."""
        return b"".join([self.parts[i] for i in ids]).decode("utf-8")

    def loss_mask(self, ids: np.ndarray, assistant: np.ndarray) -> np.ndarray:
        """For the ids of whole turns: is the token text of a turn whose entry in assistant is true?"""
        opened = np.cumsum(ids == self.end_inst) - np.cumsum(ids == self.eos)
        turn = np.cumsum(ids == self.bos) - 1
        return (opened > 0) & (ids != self.end_inst) & assistant[turn]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Formatter:
    return Formatter(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: ``conv_id, turn, tie, ids, loss_mask``, in no order.

    A conversation's formatted ids are those of its rows in order of (turn, role, hash of text),
    the last two as ``tie``. Every turn is encoded on its own, so a conversation of any length is
    spread over all tasks. Null role or text counts as empty; a null conv_id is a conversation of
    its own; null turns come first; equal rows are formatted once each.
    """
    path = path or vocabulary()

    def run(batches):
        f = load(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                roles = [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in part.column(3)]
                texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in part.column(4)]
                ids = [np.array(f.turn(r, t), np.int32) for r, t in zip(f.encode(roles), f.encode(texts))]
                masks = [f.loss_mask(i, np.array([r == ASSISTANT])) for i, r in zip(ids, roles)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                    ["conv_id", "turn", "tie", "ids", "loss_mask"],
                )

    tie = F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.sha2(raw("text"), 256))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), tie.alias("tie"), raw("role").alias("r"), raw("text").alias("t"))
    return rows.mapInArrow(run, "conv_id long, turn long, tie string, ids array<int>, loss_mask array<boolean>")


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, from formatted ids alone: counts and digests of what they say.

    Rows stream past in order, and only running hashes are held, so a conversation with a third of
    all turns needs no more memory than another.
    """
    path = path or vocabulary()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        f = load(path)
        done, conv, state = [], None, None

        def close():
            n, turns_, loss_n, loss, chars = state
            done.append((conv, n, turns_.hexdigest(), loss_n, loss.hexdigest(), chars))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done.clear()
            return out

        for b in batches:
            for c, ids, mask in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = ids.values.to_numpy()
                mask = mask.values.to_numpy(zero_copy_only=False)
                for a, z in zip(np.flatnonzero(ids == f.bos), np.flatnonzero(ids == f.eos)):
                    mid = a + int(np.argmax(ids[a:z] == f.end_inst))
                    role, text = f.decode(ids[a + 2 : mid].tolist()), f.decode(ids[mid + 1 : z].tolist())
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    counted = unescape(f.decode(ids[a : z + 1][mask[a : z + 1]].tolist()))
                    state[2] += len(counted)
                    state[3].update(counted.encode())
                    state[4] += f.control_chars + len(role) + len(text)
            if len(done) >= 1024:
                yield flush()
        if state is not None:
            close()
        if done:
            yield flush()

    dealt = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return dealt.select("conv_id", "ids", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: A conversation whose texts look like the template.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text")
    )
    return read_back(format_turns(rows.union(probe)))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
ordered AS (
  SELECT *, regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS shown_role,
         regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS shown_text,
         role || chr(10) || sha256(text) AS tie FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(shown_role) + length(shown_text))::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
"""
