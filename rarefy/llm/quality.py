"""Quality classification by co-training two views of a document.

One classifier sees the text alone, the other the metadata alone (source, language, length).
Both start from the same labelled documents. In each round, each scores all unlabelled documents,
and those of which it is surest join the other one's training set, with their pseudo-labels. In the
end both are calibrated on labelled documents that neither was trained on, and their log-odds are
combined.

The labelled documents are a sample of ``LABELLED`` at most, the first by a hash of their ids among
those that the corpus has; all others take part as unlabelled ones. What reaches the driver are the
views of the labelled sample and of ``HANDED`` documents per round, view and class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, materialize, raw
from .language import held_out

LABELLED = 6000
ROUNDS = 5
#: Pseudo-labels that a view hands over per round and class, and how sure it must be.
HANDED, SURE = 100, 0.95
WORDS, SHAPES, META = 256, 64, 96
#: A document goes below this probability: where in doubt, it stays.
KEEP = 0.4
_MARKS = b"|%$#*&!?.,;:@<>{}[]()=\"'/\\_-+~^`"


def text_view(data: bytes) -> np.ndarray:
    """Hashed words, hashed word shapes, and shares of marks, capitals, digits, repeated lines and words."""
    out = np.zeros(WORDS + SHAPES + len(_MARKS) + 12)
    words = data.lower().split()
    n, again = len(words), 0.0
    if n:
        crc = zlib.crc32
        hashed = np.fromiter(map(crc, words), np.int64, n)
        out[:WORDS] = np.bincount(hashed % WORDS, minlength=WORDS) / n
        again = np.count_nonzero(hashed[1:] == hashed[:-1]) / n
        # a word's shape: its last byte if that is no letter, and its length
        tails = np.fromiter((w[-1] for w in words), np.int64, n)
        sizes = np.minimum(np.fromiter(map(len, words), np.int64, n), 15)
        marks = np.where(tails < 64, tails % 32, 31)
        out[WORDS : WORDS + SHAPES] = np.r_[np.bincount(marks, minlength=32), np.bincount(sizes, minlength=32)] / n
    size = max(1, len(data))
    at = WORDS + SHAPES
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[at : at + len(_MARKS)] = np.minimum(1, count[list(_MARKS)] / size * 10)
    lines = data.split(b"\n")
    at += len(_MARKS)
    out[at : at + 12] = (
        np.log1p(n) / 10, np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), len(set(words)) / max(1, n), count[65:91].sum() / size,
        count[48:58].sum() / size, count[97:123].sum() / size, count[128:].sum() / size, size / max(1, n) / 10, n == 0,
        again, min(1, 20 * again),
    )
    return out


def meta_view(source: bytes | None, lang: bytes | None, n_chars: int | None) -> np.ndarray:
    """One-hot (hashed) source and language, length on a log scale in steps, and what is missing."""
    out = np.zeros(META)
    out[0 if source is None else 1 + zlib.crc32(source) % 47] = 1
    out[48 if lang is None else 49 + zlib.crc32(lang) % 15] = 1
    out[64 if n_chars is None or n_chars < 0 else 65 + min(30, int(2 * np.log2(1 + n_chars)))] = 1
    return out


def views(docs: DataFrame) -> DataFrame:
    """``doc_id, tv, mv`` of every row: both views as 32-bit floats, made once for all rounds."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                t = [text_view(x.as_buffer().to_pybytes()).astype("<f4").tobytes() for x in part.column(1)]
                m = [meta_view(*row).astype("<f4").tobytes() for row in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "tv", "mv"])

    rows = docs.select(F.col("doc_id").cast("long"), raw("text").alias("t"), F.col("source").cast("binary"), F.col("lang").cast("binary"), F.col("n_chars").cast("long"))
    return rows.mapInArrow(run, "doc_id long, tv binary, mv binary")


class Logistic:
    """L2-regularised logistic regression by Newton steps, on standardised features."""

    def __init__(self, penalty: float = 30.0):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], self.penalty)
        ridge[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


class Platt:
    """Calibration of log-odds: a slope and an intercept, fitted to smoothed labels.

    Both are drawn a little towards leaving the odds as they are, so that few or perfectly
    separated labels give finite values; Newton steps are bounded for the same reason.
    """

    def fit(self, s: np.ndarray, y: np.ndarray) -> Platt:
        ones = y.sum()
        t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        x, w, start = np.c_[s, np.ones(len(s))], np.array([1.0, 0.0]), np.array([1.0, 0.0])
        ridge = np.array([0.3, 0.03])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (t - p) - ridge * (w - start))
            w = w + np.clip(step, -0.5, 0.5)
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(0.0, w[0]), w[1]
        return self

    def __call__(self, s):
        return self.slope * s + self.shift


class CoTrained:
    def __init__(self, prior: float):
        self.prior = prior
        self.models: list = []

    def fit(self, views, y, surest, rounds: int = ROUNDS) -> CoTrained:
        """views: (text, metadata) matrices of the labelled rows.

        surest(models, gates): of the unlabelled documents not handed over yet, for each view those
        that its gated log-odds are surest of, as (text rows, metadata rows, labels). Two thirds of
        the labelled rows train, a sixth calibrates the views, for the rounds and in the end, and a
        sixth their sum. Where a sixth lacks a class, both do its work; where these do, there is no model.
        """
        turn = np.arange(len(y)) % 6
        train, rest = turn < 4, turn >= 4
        if len(set(y[rest])) < 2 or len(set(y[train])) < 2:
            return self
        scale, last = (turn == k if len(set(y[turn == k])) == 2 else rest for k in (4, 5))
        sets = [(v[train], y[train]) for v in views]
        models = [Logistic().fit(*s) for s in sets]
        for _ in range(rounds):
            # sure by calibrated odds: a strongly regularised view is shy otherwise
            gates = [Platt().fit(m.odds(v[scale]), y[scale]) for m, v in zip(models, views)]
            handed = surest(models, gates)
            if not any(len(label) for *_, label in handed):
                break
            for k, rows in enumerate(handed):
                # what one view is sure of teaches the other
                own, (x, label) = 1 - k, sets[1 - k]
                if len(rows[2]):
                    sets[own] = np.concatenate([x, rows[own]]), np.concatenate([label, rows[2]])
            models = [Logistic().fit(*s) for s in sets]
        self.base = np.log(y[rest].mean() / (1 - y[rest].mean()))
        scales = [Platt().fit(m.odds(v[scale]), y[scale]) for m, v in zip(models, views)]
        self.models = list(zip(models, scales))
        self.last = Platt().fit(self._sum([v[last] for v in views]), y[last])
        return self

    def _sum(self, views):
        # both views carry the prior once each; it counts once
        return sum(scale(m.odds(v)) for (m, scale), v in zip(self.models, views)) - self.base

    def score(self, views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text-only and metadata-only probabilities."""
        if not self.models:
            p = np.full(len(views[0]), self.prior)
            return p, p, p
        logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        own = [logistic(scale(m.odds(v))) for (m, scale), v in zip(self.models, views)]
        return logistic(self.last(self._sum(views))), *own


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f4") for x in column]).astype(float)


def _of_ids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """``doc_id, x``: the views of a bounded list of documents, once each; nothing else is shuffled."""
    chosen = rows.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("tv", "mv")).alias("x"))


_SURE_SQL = "view int, good boolean, sure double, doc_id long, tv binary, mv binary"


def _surest_of(free: DataFrame, handed: set[int]):
    """The distributed half of a round: every unlabelled document is scored by both views.

    A task keeps the HANDED surest of each view and class among its rows, and of all tasks' the
    HANDED surest are taken; of ties the smaller id, and of repeated ids one row.
    """
    schema = pa.schema([("view", pa.int32()), ("good", pa.bool_()), ("sure", pa.float64()), ("doc_id", pa.int64()), ("tv", pa.binary()), ("mv", pa.binary())])
    least = np.log(SURE / (1 - SURE))

    def surest(models, gates):
        gone = np.sort(np.fromiter(handed, np.int64, len(handed)))

        def run(batches):
            best: dict[tuple, dict] = {(k, good): {} for k in (0, 1) for good in (True, False)}
            for b in batches:
                ids = b.column(0).to_numpy()
                for at in range(0, b.num_rows, 1024):
                    part = slice(at, at + 1024)
                    fresh = ~np.isin(ids[part], gone)
                    for k, (model, gate) in enumerate(zip(models, gates)):
                        odds = gate(model.odds(_matrix(b.column(1 + k).slice(at, 1024).to_pylist())))
                        for good in (True, False):
                            held = best[k, good]
                            for i in np.flatnonzero(fresh & ((odds > least) if good else (odds < -least))):
                                held[int(ids[at + i])] = (abs(float(odds[i])), b.column(1)[at + i].as_py(), b.column(2)[at + i].as_py())
                            if len(held) > HANDED:
                                kept = sorted(held, key=lambda d: (-held[d][0], d))[:HANDED]
                                best[k, good] = {d: held[d] for d in kept}
            rows = [(k, good, v[0], d, v[1], v[2]) for (k, good), held in best.items() for d, v in held.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        found = materialize(free.mapInArrow(run, _SURE_SQL), "surest")
        out, taken = [], set()
        for k in (0, 1):
            parts = []
            for good in (True, False):
                own = found.where((F.col("view") == k) & (F.col("good") == good))
                # a document that other tasks have too is there once for each, with one result
                top = own.groupBy("doc_id").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "doc_id").limit(HANDED).collect()
                rows = {r.doc_id: r.x for r in _of_ids(own, [r.doc_id for r in top]).collect()}
                parts += [(r.doc_id, rows[r.doc_id].tv, rows[r.doc_id].mv, float(good)) for r in top]
            taken |= {p[0] for p in parts}
            empty = np.zeros((0, 1))
            out.append((_matrix([p[1] for p in parts]), _matrix([p[2] for p in parts]), np.array([p[3] for p in parts])) if parts else (empty, empty, np.zeros(0)))
        handed.update(taken)
        discard(found)
        return out

    return surest


def train(seen: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """seen: rows of ``views``. Labels are rows ``(doc_id, quality)``; those that aren't 0 or 1, or contradict one another, are left out.

    Labels of documents that the table lacks don't count; rows without an id neither train nor are
    handed over; of rows that repeat an id one does.
    """
    clean = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    clean = clean.where("y = z").select("doc_id", F.col("y").cast("double").alias("y"))
    # only ids meet the labels; the views of those that are chosen are fetched by a list of bounded size
    known = seen.select("doc_id").join(clean, "doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled).collect()
    label = {r.doc_id: r.y for r in known}
    have = sorted(_of_ids(seen, list(label)).collect(), key=lambda r: zlib.crc32(b"%d" % r.doc_id))
    y = np.array([label[r.doc_id] for r in have])
    model = CoTrained(float(y.mean()) if len(y) else KEEP)
    if not len(y):
        return model
    free = seen.where("doc_id is not null").select("doc_id", "tv", "mv")
    return model.fit([_matrix([r.x[c] for r in have]) for c in ("tv", "mv")], y, _surest_of(free, set(label)), rounds)


def classify(seen: DataFrame, model: CoTrained) -> DataFrame:
    """``doc_id, score, kept, text_score, meta_score`` of every row of ``views``; score is the probability of good quality.

    * null and empty texts are scored like any other, as texts without words; so are null source,
      language and length, each a value of its own;
    * without labels of both kinds every score is the share of good ones, or KEEP if there are none;
      a score equal to KEEP is kept;
    * repeated rows are scored alike; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                score, text, meta = model.score([_matrix(part.column(k).to_pylist()) for k in (1, 2)])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in (score, score >= KEEP, text, meta))], ["doc_id", "score", "kept", "text_score", "meta_score"])

    return seen.select("doc_id", "tv", "mv").mapInArrow(run, "doc_id long, score double, kept boolean, text_score double, meta_score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = materialize(views(documents(spark, sf_dir)), "views")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(seen, train(seen, labels.where(~held_out())))
