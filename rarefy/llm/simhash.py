"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, so that neighbours differ in few bits.
Consecutive fingerprints form leaf groups, and groups form upper nodes; a node holds the bit
positions on which all of its members agree (mask) and their values there (pattern). Two nodes
whose patterns differ in more than ``distance`` commonly masked bits cannot hold a link, and
the whole pair of groups is pruned; the count only grows on the way down, because children
mask at least the bits that their parent masks.

The top node of the index is a run: all fingerprints with the same leading bits. To meet every
link in some run the bits are dealt in four rotations: with at most three differing bits, one of
four disjoint blocks is equal, so one rotation brings it to the front. A run above ``RUN_ROWS``
fingerprints is divided by the same step over the bits that are left; after five steps 48 bits
are fixed and a run holds 2**16 different fingerprints at most, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, materialize, numbered, partitions, raw
from .components import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Above so many distinct fingerprints a run is divided further; never dropped or cut.
RUN_ROWS = 1 << 16
FANOUT = 4
#: Runs up to this length are one leaf: neighbours in Gray order are compared directly.
LEAF = 32


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: words between ASCII white space, A-Z lowered."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row; null and empty texts get zero."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in b.column(1)), dtype="<u8", count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), raw("text").alias("t")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the index over one run


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of each code word in Gray order."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unions the sets of i and j; label holds the root of each entry before and after."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _nodes(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of every node, from the fingerprints up to a few top nodes."""
    levels = [(np.full(len(fps), ~np.uint64(0)), fps)]
    while len(levels[-1][0]) > FANOUT:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FANOUT)
        first = np.repeat(pattern[at], FANOUT)[: len(mask)]
        shared = np.bitwise_and.reduceat(mask, at) & ~np.bitwise_or.reduceat(pattern ^ first, at)
        levels.append((shared, pattern[at] & shared))
    return levels


def _one_set(label: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For every node: the set that all its members are in, or -1."""
    out = [label]
    for n in sizes[1:]:
        below = out[-1]
        at = np.arange(0, len(below), FANOUT)
        low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
        out.append(np.where((low == high), low, -1))
        assert len(out[-1]) == n
    return out


def link_run(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The root (an index) of every fingerprint of a run in Gray order; links within the run only.

    Pairs of groups are pruned by accumulated differences, and when both lie in one set already,
    so that a dense cloud of near copies costs about its size rather than its square.
    """
    n = len(fps)
    label = np.arange(n)
    near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= distance)
    label = _merge(label, near, near + 1)
    levels = _nodes(fps)
    sizes = [len(m) for m, _ in levels]
    sets = _one_set(label, sizes)
    top = len(levels) - 1
    a, b = np.triu_indices(sizes[top])
    stack = [(top, a, b)]
    step = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        if len(a) > 1 << 15:
            stack.append((level, a[1 << 15 :], b[1 << 15 :]))
            a, b = a[: 1 << 15], b[: 1 << 15]
        mask, pattern = levels[level]
        differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
        keep = (differ <= distance) & ~((sets[level][a] == sets[level][b]) & (sets[level][a] >= 0))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            label = _merge(label, a, b)
            sets = _one_set(label, sizes)
            continue
        x = (a[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, axis=2).ravel()
        y = (b[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, axis=1).ravel()
        ok = (x < sizes[level - 1]) & (y < sizes[level - 1]) & (x <= y)
        stack.append((level - 1, x[ok], y[ok]))
    return label


def _link_short(key: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """As link_run, over many short runs at once: each is one leaf."""
    label = np.arange(len(fps))
    for k in range(1, LEAF):
        if len(fps) <= k:
            break
        same = key[k:] == key[:-k]
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.bitwise_count(fps[k:] ^ fps[:-k]) <= distance))
        if len(hit):
            label = _merge(label, hit, hit + k)
    return label


def _link(runs: np.ndarray, codes: np.ndarray, distance: int):
    """Pairs (i, root of i) over whole runs; runs holds the number of each row's run, ascending."""
    start = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    size = np.diff(np.r_[start, len(runs)])
    of = np.repeat(size, size)
    at = np.flatnonzero((of > 1) & (of <= LEAF))
    if len(at):
        root = _link_short(runs[at], codes[at], distance)
        moved = np.flatnonzero(root != np.arange(len(at)))
        yield at[moved], at[root[moved]]
    for s, n in zip(start[size > LEAF], size[size > LEAF]):
        root = link_run(codes[s : s + n], distance)
        moved = np.flatnonzero(root != np.arange(n))
        yield s + moved, s + root[moved]


# ---------------------------------------------------------------- dealing runs to tasks


def _rotations(code: Column, fixed: int) -> tuple[Column, int]:
    """An array of (turn, code), the bits below the fixed ones turned by each of four blocks."""
    left = 64 - fixed
    width = left // 4
    ones = F.lit((1 << left) - 1 if fixed else -1)
    low, high = code.bitwiseAND(ones), code.bitwiseAND(F.bitwise_not(ones))
    turned = []
    for r in range(4):
        k = width * r
        spun = low if not k else F.shiftleft(low, k).bitwiseAND(ones).bitwiseOR(F.shiftrightunsigned(low, left - k))
        turned.append(F.struct(F.lit(r).alias("turn"), high.bitwiseOR(spun).alias("code")))
    return F.array(*turned), fixed + width


def _rank(code: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _edges_of_runs(rows: DataFrame, fixed: int, distance: int) -> DataFrame:
    """rows (path, code, fp): links within each run (path, leading bits) as edges (a, b) of fingerprints."""

    def run(batches):
        held = None

        def linked(path, code, fp):
            runs = np.cumsum(np.r_[0, (path[1:] != path[:-1]) | ((code[1:] ^ code[:-1]) >> shift != 0)])
            for i, j in _link(runs, code, distance):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i].view("<i8")), pa.array(fp[j].view("<i8"))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(0).to_numpy(zero_copy_only=False)] + [b.column(k).to_numpy(zero_copy_only=False).view("<u8") for k in (1, 2)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            path, code, fp = now
            # the last run may go on in the next batch
            other = np.flatnonzero((path != path[-1]) | ((code ^ code[-1]) >> shift != 0))
            cut = other[-1] + 1 if len(other) else 0
            yield from linked(path[:cut], code[:cut], fp[:cut])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from linked(*held)

    shift = np.uint64(64 - fixed)
    prefix = F.shiftrightunsigned("code", 64 - fixed)
    dealt = rows.repartition(partitions(rows.sparkSession), "path", prefix)
    return dealt.sortWithinPartitions("path", prefix, _rank(F.col("code"))).mapInArrow(run, "a long, b long")


def link_edges(distinct: DataFrame, distance: int = DISTANCE, run_rows: int = RUN_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``distance`` (3 at most) of one another.

    distinct: one column ``fp`` without repeats. A spanning set of links per run, not all pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("four rotations meet links of up to 3 differing bits")
    rows, fixed, found = distinct.select(F.lit(0).alias("path"), F.col("fp").alias("code"), "fp"), 0, []
    while True:
        turns, fixed = _rotations(F.col("code"), fixed)
        rows = rows.select("path", "fp", F.explode(turns).alias("s")).select(
            (F.col("path") * 4 + F.col("s.turn")).alias("path"), F.col("s.code").alias("code"), "fp"
        )
        if fixed >= 48:
            break
        key = ["path", F.shiftrightunsigned("code", 64 - fixed).alias("prefix")]
        hot = rows.groupBy(*key).count().where(F.col("count") > run_rows).select("path", "prefix")
        if hot.isEmpty():
            break
        hot = materialize(hot, "hot-runs")
        with_key = rows.withColumn("prefix", key[1])
        found.append(_edges_of_runs(with_key.join(hot, ["path", "prefix"], "left_anti").select("path", "code", "fp"), fixed, distance))
        rows = materialize(with_key.join(hot, ["path", "prefix"], "left_semi").select("path", "code", "fp"), "runs")
    found.append(_edges_of_runs(rows.select("path", "code", "fp"), fixed, distance))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    * null and empty texts, and texts of white space only, have fingerprint zero and are linked
      like any other;
    * texts of fewer than three words hash as one shingle;
    * repeated rows stay repeated, with equal results; ties do not arise, as a component is named
      by its smallest ``doc_id`` (null only if all its ids are null);
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(link_edges(reps.select("fp"), distance, run_rows))
    # the root itself has no row among the star edges
    member = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = reps.join(member, reps.fp == member.node).select("fp", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    per_fp = reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(per_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component one row of its smallest ``doc_id`` stays.

    * rows without a doc_id are linked like any other and come after all ids; rows of one id are
      ordered by a hash of their text, so a row that is repeated with its doc_id stays once;
    * null and empty texts, and texts of white space only, are near copies of one another;
    * an empty table stays empty; columns keep their names and order, whatever they are.
    """
    rows = numbered(docs, "near-rows")
    fps = fingerprints(rows.select(F.col("row").alias("doc_id"), "doc.text")).withColumnRenamed("doc_id", "row")
    doc_id = F.col("doc.doc_id").cast("long")
    order = F.struct(doc_id.isNull(), doc_id, F.xxhash64(raw("doc.text")), "row").alias("order")
    fps = materialize(fps.join(rows.select("row", order), "row"), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("order").alias("first"))
    roots = connected_components(link_edges(reps.select("fp")))
    # a root has no row among the star edges, and what isn't linked is its own root
    linked = reps.join(roots, reps.fp == roots.node, "left")
    stays = linked.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first")["row"].alias("row"))
    return rows.join(stays.select("row"), "row", "left_semi").select("doc.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
