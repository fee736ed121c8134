"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. A letter
n-gram is bound into one vector: the product of its letters' vectors, each permuted (rolled)
by its place. A text is the bundle (sum) of its n-gram vectors, a language the bundle of all
its training texts; a text gets the language with the highest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, materialize, raw

DIMS = 512
NGRAM = 3
SEED = 7
#: Languages whose profiles are compared with a text at one time.
LANGUAGE_ROWS = 4096
#: n-gram vectors that a worker keeps at once (x DIMS x 4 bytes); older ones are made anew.
KEPT_VECTORS = 1 << 15
UND = "und"


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


_LETTERS: np.ndarray | None = None
_BLANK = 32


def letter_ngrams(text: str, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (packed code points) and their counts; runs of other characters count as one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    c = np.where(is_letter, c, _BLANK)
    c = np.r_[_BLANK, c, _BLANK].astype("<u8")
    c = c[np.r_[True, (c[1:] != _BLANK) | (c[:-1] != _BLANK)]]
    if len(c) < n:
        c = np.r_[c, np.full(n - len(c), _BLANK, "<u8")]
    packed = np.zeros(len(c) - n + 1, "<u8")
    for k in range(n):
        packed = (packed << np.uint64(21)) | c[k : len(c) - n + 1 + k]
    return np.unique(packed, return_counts=True)


class Vectors:
    """n-gram vectors on demand; what is kept is bounded, what is made depends on code points alone."""

    def __init__(self, dims: int = DIMS, n: int = NGRAM, seed: int = SEED):
        self.dims, self.n, self.seed = dims, n, seed
        self.rows = np.empty((KEPT_VECTORS, dims), np.float32)
        self.forget()

    def forget(self) -> None:
        self.letters: dict[tuple[int, int], np.ndarray] = {}
        self.codes, self.places = np.empty(0, "<u8"), np.empty(0, np.int64)

    def letter(self, code: int, turn: int) -> np.ndarray:
        """A letter's vector, permuted for its place."""
        v = self.letters.get((code, turn))
        if v is None:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, self.dims, dtype=np.int8)
            v = self.letters[code, turn] = np.roll((2 * bits - 1).astype(np.float32), turn)
        return v

    def bind(self, code: int, out: np.ndarray) -> None:
        out[:] = 1
        for turn in range(self.n):
            out *= self.letter((code >> 21 * turn) & 0x1FFFFF, turn)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Places in rows of the (sorted, distinct) codes, KEPT_VECTORS at most."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            if len(self.codes) + np.count_nonzero(~known) > KEPT_VECTORS:
                self.forget()
                known[:] = False
            new = codes[~known]
            places = np.arange(len(self.codes), len(self.codes) + len(new))
            for place, code in zip(places, new.tolist()):
                self.bind(code, self.rows[place])
            order = np.argsort(np.r_[self.codes, new], kind="stable")
            self.codes, self.places = np.r_[self.codes, new][order], np.r_[self.places, places][order]
            at = np.searchsorted(self.codes, codes)
        return self.places[at]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims)
        for at in range(0, len(codes), KEPT_VECTORS // 4):
            part = slice(at, at + KEPT_VECTORS // 4)
            total += counts[part].astype(np.float32) @ self.rows[self.index(codes[part])]
        return total


Profiles = tuple[list[str], np.ndarray]


def learn(docs: DataFrame, dims: int = DIMS, n: int = NGRAM, seed: int = SEED) -> Profiles:
    """Languages in code-point order and their profiles, from rows ``(text, lang)``: the first LANGUAGE_ROWS of them."""
    return next(learn_blocks(docs, dims, n, seed))


def learn_blocks(docs: DataFrame, dims: int = DIMS, n: int = NGRAM, seed: int = SEED):
    """Yields all languages and profiles, LANGUAGE_ROWS at a time, in code-point order; one empty block if there are none.

    Rows without lang, and languages without a letter, are left out. Each task bundles its own rows by
    language and sends one vector for each, so what is shuffled depends on the number of languages
    only, and what is on the driver at one time on LANGUAGE_ROWS.
    """

    def run(batches):
        held: dict[bytes, list] = {}
        size, vectors, out = 0, Vectors(dims, n, seed), {}

        def flush():
            for lang, found in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([k for _, k in found]))
                v = vectors.bundle(codes, counts)
                out[lang] = out[lang] + v if lang in out else v
            held.clear()

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], ["name", "v"])
            out.clear()
            return batch

        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0)):
                found = letter_ngrams(_decoded(text), n)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
                if size > 1 << 20:
                    flush()
                    size = 0
                    if len(out) > LANGUAGE_ROWS:
                        yield rows()
        flush()
        if out:
            yield rows()

    rows = docs.where("lang is not null").select(raw("text").alias("t"), F.col("lang").cast("binary").alias("name"))
    parts = rows.mapInArrow(run, "name binary, v array<double>")
    total = parts.groupBy("name").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(dims))).alias("v"))
    got = total.orderBy("name").limit(LANGUAGE_ROWS + 1).collect()
    if len(got) <= LANGUAGE_ROWS:
        yield _profiles(got, dims)
        return
    # so many values that they are kept in a table and looked at block by block
    table = materialize(total, "profiles")
    last = None
    while got := (table if last is None else table.where(F.col("name") > F.lit(last))).orderBy("name").limit(LANGUAGE_ROWS).collect():
        yield _profiles(got, dims)
        last = bytes(got[-1].name)


def _profiles(rows, dims: int) -> Profiles:
    rows = [r for r in rows if np.any(r.v)]
    return [bytes(r.name).decode("utf-8", "replace") for r in rows], np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), dims)


def _decoded(text: pa.Scalar) -> str:
    """A text cell (string or bytes); what isn't UTF-8 is replaced, null is empty."""
    return text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else ""


class Scorer:
    """The language of a text by one block of profiles."""

    def __init__(self, langs: list[str], profiles: np.ndarray, n: int = NGRAM, seed: int = SEED):
        self.langs, self.n = langs, n
        self.unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
        self.vectors = Vectors(profiles.shape[1] if len(langs) else DIMS, n, seed)

    def best(self, text: str) -> tuple[str, float]:
        """The language and its cosine, or ``und`` and -1."""
        codes, counts = letter_ngrams(text, self.n)
        if not len(codes) or not self.langs:
            return UND, -1.0
        v = self.vectors.bundle(codes, counts)
        cos = self.unit @ v / max(np.linalg.norm(v), 1e-12)
        k = int(cos.argmax())
        return self.langs[k], float(cos[k])


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``identify_blocks`` with one block of profiles."""
    return identify_blocks(docs, [(langs, profiles)], n, seed)


def identify_blocks(docs: DataFrame, blocks, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; only the text is looked at.

    * score is the cosine with the chosen profile, 0 where it is negative;
    * a null text, a text without a letter, or no profile at all gives ``und`` and 0; text that isn't
      UTF-8 is read with replacement characters, which aren't letters;
    * equal cosines go to the first language in code-point order;
    * more languages than one block holds are compared block after block, with the same result;
    * repeated rows are scored alike; an empty table gives an empty result.
    """

    def scored(langs, profiles):
        def run(batches):
            scorer = Scorer(langs, profiles, n, seed)
            for b in batches:
                best = []
                for text, pred, score in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    new = scorer.best(_decoded(text))
                    best.append(new if new[1] > score else (pred, score))
                columns = [pa.array(c, t) for c, t in zip(zip(*best), (pa.string(), pa.float64()))] if best else [b.column(2), b.column(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "t", "lang_pred", "cos"])

        return run

    rows = docs.select("doc_id", raw("text").alias("t"), F.lit(UND).alias("lang_pred"), F.lit(-2.0).alias("cos"))
    for k, block in enumerate(blocks):
        rows = (materialize(rows, "scored") if k else rows).mapInArrow(scored(*block), "doc_id long, t binary, lang_pred string, cos double")
    return rows.select("doc_id", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cos")).alias("score"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_split(docs: DataFrame):
    """Blocks of profiles from the documents that aren't held out (a fixed quarter by id)."""
    return learn_blocks(docs.where(~held_out()))


def accept(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``identify`` calls ``und``: no letter in the text, or no text.

    Every row is identified; whether it is ``und`` doesn't depend on which languages are known, so one
    block of profiles decides. Null ids and repeated rows are judged like others; texts that aren't
    UTF-8 are read as ``identify`` reads them, and pass unchanged; without any language everything is
    ``und``; an empty table stays empty; columns keep their names and order, whatever they are.
    """
    langs, profiles = next(learn_split(docs))
    at = docs.columns.index("text")

    def run(batches):
        # the rows themselves are looked at, so that no text is shuffled to meet its verdict
        scorer = Scorer(langs, profiles)
        for b in batches:
            yield b.filter(pa.array([scorer.best(_decoded(text))[0] != UND for text in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = identify_blocks(docs, learn_split(docs))
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
