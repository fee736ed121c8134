"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The model is built from a rank file. A token of the file is a byte string; byte-level BPE writes
each byte as one printable character (the byte table), and decoding reverses that table. The
merges are all pairs of tokens whose concatenation is a token, in the order of its rank, which is
how ranks alone define merging.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, raw

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts are handed to the library in groups of about so many bytes.
GROUP_BYTES = 1 << 21


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [chr(b) if b in plain else moved[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        shown = {t: "".join(table[b] for b in t) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    merges.append((shown[token[:k]], shown[token[k:]]))
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        # decoding: the reversed byte table of every id, as one buffer and places in it
        back = {c: b for b, c in enumerate(table)}
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for text, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            parts[i] = bytes(back[c] for c in text)
        self.length = np.fromiter(map(len, parts), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; characters that are split over tokens are whole again."""
        n = self.length[ids]
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - n), n)
        return self.flat[at].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 character of each token; tokens of a split character share that character."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80)  # 1 + the character that each byte belongs to
        end = np.cumsum(self.length[ids])
        return char[end - self.length[ids]] - 1, char[end - 1]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _grouped(texts):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str | None = None, offsets: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens`` (and ``starts, ends`` in characters) for every row.

    Null and empty texts have no tokens. Special tokens are never made: their strings are ordinary
    text. Texts are encoded whole, whatever their length; repeated rows get equal results; an empty
    table gives an empty result; other columns are ignored.
    """
    path = path or vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            at = 0
            for group in _grouped(t.as_buffer().to_pybytes() for t in b.column(1)):
                ids = bpe.encode([t.decode("utf-8", "replace") for t in group])
                cols = [b.column(0).slice(at, len(group)), pa.array([i.view("<i4") for i in ids], pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())]
                names = ["doc_id", "ids", "n_tokens"]
                if offsets:
                    spans = [bpe.offsets(i) for i in ids]
                    cols += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(group)

    more = ", starts array<long>, ends array<long>" if offsets else ""
    return docs.select("doc_id", raw("text").alias("t")).mapInArrow(run, f"doc_id long, ids array<int>, n_tokens long{more}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, bytes`` of every row ``(doc_id, ids)``; null ids give empty bytes."""
    path = path or vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            out = [bpe.decode(np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.empty(0, np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every text and decodes its ids again, in one pass over the texts.

    ``doc_id, ids, n_tokens, ids_sha256`` (of the ids as little-endian 32-bit integers) and
    ``decoded_sha256`` (of the decoded bytes); empty and repeated rows as in ``encode``.
    """
    path = path or vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            at = 0
            for group in _grouped(t.as_buffer().to_pybytes() for t in b.column(1)):
                ids = bpe.encode([t.decode("utf-8", "replace") for t in group])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(group)),
                        pa.array([i.view("<i4") for i in ids], pa.list_(pa.int32())),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
                    ],
                    ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(group)

    return docs.select("doc_id", raw("text").alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(documents(spark, sf_dir)).drop("ids")
