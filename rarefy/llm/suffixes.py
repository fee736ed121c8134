"""Removal of repeated passages through suffix arrays.

A byte is removed where a string of ``LENGTH`` bytes covers it that also starts in a document
with a smaller id. Suffix arrays decide that, over fragments of texts; hashes only choose which
fragments have to be looked at, and deal them so that fragments with a common string meet:

1. In every window of LENGTH bytes the 16-byte gram with the smallest hash is an anchor, so equal
   strings have equal anchors at equal places. A string reaches at least SIDE bytes to the left of
   its anchor or more than that to the right; so two documents that share one also share the key of
   a side: the hash of the anchor with SIDE bytes before it, or with as many and one behind it.
2. Keys are dealt by hash, those of a chunk of documents joined before the shuffle: a passage that a
   third of all documents have is one entry per chunk. A side whose key has only one document can
   share nothing; the others come back to their documents as candidates.
3. The fragment around each candidate side, all strings of LENGTH bytes on that side, is cut from its
   text and dealt by its key. Equal fragments of a chunk, compared byte by byte, travel as one, with
   the smallest id. Keys with very many different fragments (the edges of a common passage) deal
   each string of a fragment by its own hash instead.
4. A two-stage suffix array sorts the fragments of a bucket: only suffixes smaller than their
   successor are sorted directly, the others are induced by one scan over the buckets. Adjacent
   common prefixes of LENGTH or more give the runs of equal strings, and the smallest id of a run
   says which fragments repeat it.

Hash collisions cost time and nothing else: no two strings count as equal without their bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, materialize, partitions, raw

LENGTH = 50
GRAM = 16
#: Anchors that a map task holds before it deals them out, and fragments.
CHUNK_ANCHORS, CHUNK_FRAGMENTS = 1 << 19, 1 << 17
#: Fragments that one suffix array sorts. A larger group of one key is sorted string by string, in
#: parts by the strings' hash.
SORT_FRAGMENTS = 1 << 13
#: Turns in which fragments are cut and compared, each with its share of the keys: what is on disk at
#: one time is the texts and one share.
TURNS = 2
#: Bytes of text for a bucket: what a task holds at once, whatever the number of partitions.
BUCKET_BYTES = 1 << 25
#: A key is dealt by strings if so many different fragments have it, and it is among the HOT_KEYS
#: with most: a list of bounded size. The others are sorted where they are, at any size.
HOT_FRAGMENTS, HOT_KEYS = 1 << 13, 1 << 16
#: Bytes of text that are gone over at a time, in whole texts, and places that are hashed at a time:
#: their arrays stay in the processor's cache.
BLOCK_BYTES, BLOCK_PLACES = 1 << 16, 1 << 12
_U = np.uint64
_MIX = [_U(int.from_bytes(hashlib.sha256(b"context-%d" % i).digest()[:8], "little") | 1) for i in range(16)]
#: A null id is larger than every other one.
_NULL_ID = (1 << 63) - 1


# ---------------------------------------------------------------- two-stage suffix array


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix counts as smaller."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])
    step = np.r_[step, 1]
    # equal neighbours take the type of the next step that isn't 0
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


class Codes:
    """A sequence of codes below 512 with seven-code keys, for comparisons up to a depth."""

    def __init__(self, t: np.ndarray, depth: int):
        self.t, self.depth = t, depth
        self.steps = -(-depth // 7)
        wide = np.r_[t, np.zeros(7 * self.steps + 7, t.dtype)].astype(_U)
        m = len(wide) - 6
        self.key = np.zeros(m, _U)
        for k in range(7):
            self.key = (self.key << _U(9)) | wide[k : m + k]

    def sorted(self, at: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes up to the depth; ties keep their order."""
        order = at[np.argsort(self.key[at], kind="stable")]
        k = self.key[order]
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) if len(order) else k
        for j in range(1, self.steps):
            size = np.bincount(group.astype(np.int64), minlength=1)
            tied = np.flatnonzero(size[group] > 1)
            if not len(tied):
                break
            part, g = order[tied], group[tied]
            key = self.key[part + 7 * j]
            new = np.lexsort((key, g))
            part, g, key = part[new], g[new], key[new]
            order[tied] = part
            border = np.zeros(len(order), bool)
            border[0] = True
            border[1:] = group[1:] != group[:-1]
            inner = np.r_[False, (g[1:] == g[:-1]) & (key[1:] != key[:-1])]
            border[tied[inner]] = True
            group = np.cumsum(border)
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and b, up to the depth."""
        out = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        for j in range(self.steps):
            x = self.key[a[open_] + 7 * j] ^ self.key[b[open_] + 7 * j]
            equal = np.zeros(len(x), np.int64)
            for k in range(7):
                equal += (x >> _U(9 * (6 - k))) == 0
            out[open_] += equal
            open_ = open_[equal == 7]
            if not len(open_):
                break
        return np.minimum(out, self.depth)


def suffix_array(t: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of codes (by their first ``depth`` codes) and adjacent common prefixes.

    Codes lie between 1 and 511; 0 separates texts and must come last. wanted: only these suffixes
    are returned, and sorted besides them are only successors from which one of them is induced.
    The second result's entry i belongs to the suffixes at i - 1 and i; entry 0 is 0.
    """
    n = len(t)
    codes = Codes(t, depth)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    small = _types(t)
    needed = np.ones(n, bool)
    if wanted is not None:
        # a larger suffix needs its successor, and so on up to the first smaller one
        at = np.arange(n)
        last_wanted = np.maximum.accumulate(np.where(wanted, at, -1))
        last_small = np.r_[-1, np.maximum.accumulate(np.where(small, at, -1))[:-1]]
        needed = (last_wanted >= 0) & (last_small < last_wanted) | wanted
    direct = codes.sorted(np.flatnonzero(small & needed))
    first = t[direct]
    present = np.unique(t)
    direct_of = dict(zip(present.tolist(), zip(np.searchsorted(first, present, "left"), np.searchsorted(first, present, "right"))))
    waiting: dict[int, list[np.ndarray]] = {c: [] for c in present.tolist()}

    def induce(scanned: np.ndarray, own: int) -> np.ndarray:
        """Hands each larger predecessor to its bucket, in scan order; returns those of the own bucket."""
        before = scanned[scanned > 0] - 1
        before = before[needed[before] & ~small[before]]
        if not len(before):
            return before
        head = t[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cuts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        same = before[:0]
        for s, e in zip(cuts, np.r_[cuts[1:], len(head)]):
            c = int(head[s])
            if c == own:
                same = before[s:e]
            else:
                waiting[c].append(before[s:e])
        return same

    out = []
    for c in present.tolist():
        # larger suffixes come first in a bucket, those that start with a run of c in waves
        wave = np.concatenate(waiting.pop(c)) if waiting[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        s, e = direct_of[c]
        out.append(direct[s:e])
        induce(direct[s:e], c)
    order = np.concatenate(out)
    order = order if wanted is None else order[wanted[order]]
    return order, np.r_[0, codes.common(order[:-1], order[1:])] if len(order) else order


# ---------------------------------------------------------------- anchors


def anchors(data: bytes, length: int = LENGTH, origin: np.ndarray | None = None, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text, or of the texts of a block, in order.

    origin, size: where in a block its texts begin, and their lengths, ``length`` or more.
    """
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, _U)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    h = words[: n - 15] * _MIX[12]
    h ^= h >> _U(31)
    h += words[8:] * _MIX[13]
    h ^= h >> _U(32)
    h *= _MIX[14]
    h ^= h >> _U(29)
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(n - 15, dtype=_U)
    width, low, have = length - GRAM + 1, key, 1
    while 2 * have <= width:
        low, have = np.minimum(low[: len(low) - have], low[have:]), 2 * have
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    if origin is not None:
        # strings lie within one text
        borders = np.c_[origin, origin + size - length + 1].ravel()
        inside = np.arange(len(borders) + 1) % 2 == 1
        low = low[np.repeat(inside, np.diff(borders, prepend=0, append=len(low)))]
    low = low[np.r_[True, low[1:] != low[:-1]]]
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def _blocks(rows, length: int):
    """Blocks of texts: (their rows without the text, bytes, where each text begins, its length).

    rows: (text, ...). Texts shorter than ``length`` are left out; zeros lie between texts and around them.
    """
    gap, held, size = bytes(length + 8), [], 0
    for text, *row in rows:
        if len(text) < length:
            continue
        held.append((text, row))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield _joined(held, gap)
            held, size = [], 0
    if held:
        yield _joined(held, gap)


def _joined(held: list[tuple], gap: bytes) -> tuple:
    size = np.array([len(t) for t, _ in held])
    origin = len(gap) + np.cumsum(size + len(gap)) - size - len(gap)
    return [row for _, row in held], gap + gap.join(t for t, _ in held) + 2 * gap, origin, size


def _sides(length: int) -> tuple[int, int]:
    """Bytes beside an anchor that a string on either side takes in at least: before it, and behind it."""
    left = (length - GRAM + 1) // 2
    return left, length - GRAM + 1 - left


def _width(length: int) -> int:
    """Bytes of a fragment: all strings that share the smaller side's key; whole words of 8 bytes."""
    return -(-(length + max(_sides(length)) - 1) // 8) * 8


def _hashed(data: bytes | np.ndarray, at: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place; every word is mixed before it is summed."""
    out = np.empty(len(at), _U)
    if not len(at):
        return out
    words = -(-width // 8)
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    step = 8 * np.arange(words)[:, None]
    mix = np.array([_MIX[(k + salt) % 12] + _U(2 * (k // 12)) for k in range(words)])[:, None]
    for s in range(0, len(at), BLOCK_PLACES):
        x = view[at[s : s + BLOCK_PLACES] + step]
        if width % 8:
            x[-1] &= _U((1 << 8 * (width % 8)) - 1)
        x ^= x >> _U(32)
        x *= _MIX[15 - salt]
        x ^= x >> _U(29)
        x *= mix
        x ^= x >> _U(32)
        x *= _MIX[14 - salt]
        x.sum(axis=0, dtype=_U, out=out[s : s + BLOCK_PLACES])
    out ^= out >> _U(29)
    return out


def contexts(data: bytes, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of all that lies within reach of a string around each anchor of a block."""
    before = length - GRAM
    return _hashed(data, at - before, before + length)


def keys(data: bytes, at: np.ndarray, origin: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the left and the right side of each anchor of a block; 0 where the text has no string on that side.

    origin, size: where each anchor's text begins, and its length.
    """
    left, right = _sides(length)
    out = _hashed(data, at - left, left + GRAM) | _U(1), _hashed(data, at, GRAM + right, 1) | _U(1)
    out[0][at - origin < left] = 0
    out[1][at - origin + GRAM + right > size] = 0
    return out


def _turn(key: np.ndarray, turns: int) -> np.ndarray:
    """The turn in which the fragments of a key are compared."""
    return (key >> _U(8)) % _U(turns)


def fragments(data: bytes, code: np.ndarray, origin: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each code (place of an anchor in its text * 2 + 1 for its right side) that has a string: its
    index, where its fragment begins, the first and last start of a string in it, and its bytes (zeros elsewhere).

    origin, size: where each code's text begins in a block, and its length. Fragments' places count
    from length - GRAM bytes before the text.
    """
    left, _ = _sides(length)
    before, width = length - GRAM, _width(length)
    at, side = (code >> 1).astype(np.int64), code & 1
    begin = np.where(side == 1, at + before - left + 1, at)
    starts = np.where(side == 1, left, before - left + 1)
    lo = np.maximum(0, before - begin)
    hi = np.minimum(starts - 1, size + before - length - begin)
    x = np.flatnonzero(hi >= lo)  # close to an end of the text there may be no string
    begin, starts, lo, hi = begin[x], starts[x], lo[x], hi[x]
    view = np.ndarray((len(data) - width + 1,), f"V{width}", data, strides=(1,))
    text = view[begin + origin[x] - before].view(np.uint8).reshape(-1, width)
    # what lies behind the last string, and, close to an end of the text, before the first one
    tail = left - 1 + length
    text[:, tail:] *= np.arange(tail, width) < (hi + length)[:, None]
    near = np.flatnonzero((lo > 0) | (hi < starts - 1))
    column = np.arange(width)
    text[near] *= (column >= lo[near, None]) & (column < (hi + length)[near, None])
    return x, begin, lo, hi, text


# ---------------------------------------------------------------- packing arrays into rows


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    tight = zstandard.ZstdCompressor(level=1)
    parts = [np.array([len(arrays[0])], "<u4").tobytes()]
    for a in arrays:
        # byte planes: what changes little compresses, hashes stay as they are
        data = a.tobytes() if a.dtype == _U else tight.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        parts += [np.array([len(data)], "<u4").tobytes(), data]
    return b"".join(parts)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    loose = zstandard.ZstdDecompressor()
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for kind in types:
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        part = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == "<u8":
            out.append(np.frombuffer(part, _U))
        else:
            item = np.dtype(kind).itemsize
            flat = np.frombuffer(loose.decompress(part, max_output_size=max(1, n * item)), np.uint8)
            out.append(np.ascontiguousarray(flat.reshape(item, n).T).view(kind).ravel())
    return out


def _pack_text(text: np.ndarray) -> bytes:
    """Rows of bytes, one after the other: neighbours share words."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(text).tobytes())


def _unpack_text(data: bytes, width: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, width)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


_DEALT = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary())])
_DEALT_SQL = "bucket long, ids binary, hashes binary"
_FOUND = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("load", pa.int64()), ("data", pa.binary())])
_FOUND_SQL = "dest long, kind int, load long, data binary"
#: What is found: sides to compare and spans of bytes, of a document; and keys with many fragments.
_SIDE, _SPAN, _HOT = 0, 1, 2
_ENTRY = {_SIDE: np.dtype([("code", "<u4")]), _SPAN: np.dtype([("from", "<u4"), ("to", "<u4")])}
#: In place of a side: a fragment is one string.
_STRING = 2
#: In place of a code: the entry stands for documents that are candidates already.
_NO_CODE = 0xFFFFFFFF


class _ByDocument:
    """Gathers entries of one kind and gives them out packed, one row for each destination of documents."""

    def __init__(self, kind: int, destinations: int, load: int = 0):
        self.kind, self.destinations, self.load, self.held, self.size = kind, destinations, load, [], 0

    def add(self, k, th, *columns):
        """Yields rows when enough entries are held."""
        if len(k):
            self.held.append((k, th, *columns))
            self.size += len(k)
        if self.size >= CHUNK_ANCHORS:
            yield from self.rows()

    def rows(self):
        if not self.held:
            return
        k, th, *columns = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        dest = ((k.view(_U) * _MIX[12]) >> _U(33)) % _U(self.destinations)
        order = _order(k, columns[0])
        order = order[_stable(dest[order], self.destinations)]
        k, th, dest = k[order], th[order], dest[order]
        columns = [c[order].astype(t[0]) for c, t in zip(columns, _ENTRY[self.kind].fields.values())]
        start, end = _runs(dest)
        parts = [_pack(_delta(k[s:e]), th[s:e], *(c[s:e] for c in columns)) for s, e in zip(start, end)]
        kinds = np.full(len(start), self.kind, np.int32)
        loads = np.full(len(start), self.load, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(dest[start].astype(np.int64)), pa.array(kinds), pa.array(loads), pa.array(parts, pa.binary())], schema=_FOUND)


def _gather(kind: int):
    """Of rows by destination, one row for each document: (k, th, its entries)."""
    entry = _ENTRY[kind]
    types = [t[0].str for t in entry.fields.values()]
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("entries", pa.binary())])

    def run(batches):
        for _, rows in _by_bucket(batches):
            parts = [_unpack(r[-1], "<i8", "<i8", *types) for r in rows]
            k = np.concatenate([np.cumsum(p[0]) for p in parts])
            th, *columns = (np.concatenate([p[i] for p in parts]) for i in range(1, 2 + len(types)))
            order = _order(k, columns[0])
            if ((k[order][1:] == k[order][:-1]) & (th[order][1:] != th[order][:-1])).any():
                order = np.lexsort((columns[0], th, k))
            k, th = k[order], th[order]
            entries = np.empty(len(k), entry)
            for name, c in zip(entry.names, columns):
                entries[name] = c[order]
            data, width = entries.tobytes(), entry.itemsize
            start, end = _runs(k, th)
            held = [data[s * width : e * width] for s, e in zip(start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(k[start]), pa.array(th[start]), pa.array(held, pa.binary())], schema=schema)

    return run


_GATHERED_SQL = "k long, th long, entries binary"


def _ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(new)
    return start, np.r_[start[1:], len(new)]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return _ends(new)


def _within(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Group numbers with the leading bits of ``by`` behind them: one number to sort by."""
    shift = 64 - int(group.max()).bit_length() if len(group) else 64
    return (group.astype(_U) << _U(shift)) | (by >> _U(64 - shift)) if shift < 64 else by


def _order(k: np.ndarray, by: np.ndarray) -> np.ndarray:
    """An order by ``k``, then by numbers below 2**32."""
    first = np.argsort(k)
    start, end = _runs(k[first])
    group = np.repeat(np.arange(len(start), dtype=_U), end - start)
    return first[np.argsort((group << _U(32)) | by[first].astype(_U))]


def _stable(x: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers below ``n``; short numbers are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _DEALT.types)], schema=_DEALT)


def _deal(buckets: int, length: int, turns: int = 1):
    """Map side: the sides of whole texts by bucket of their key; those of a chunk with one key are joined.

    Sides whose key several documents of the chunk have are candidates; they travel under a negative
    bucket, by turn, and one entry without a code tells the key's bucket, with the number of different contexts.
    """

    def dealt(held):
        ids, ths, count = (np.concatenate([x[i] for x in held]) for i in range(3))
        by_id = np.lexsort((ths, ids))
        # rows that repeat an id with its text are one document
        by_id = by_id[np.r_[True, (ids[by_id][1:] != ids[by_id][:-1]) | (ths[by_id][1:] != ths[by_id][:-1])]]
        first = (np.cumsum(count) - count)[by_id]
        ids, ths, count = ids[by_id], ths[by_id], count[by_id]
        doc = np.repeat(np.arange(len(ids)), count)
        pick = np.arange(len(doc)) + np.repeat(first - (np.cumsum(count) - count), count)
        # in order of documents and places, each anchor's left side before its right one
        code, key = np.empty(2 * len(doc), "<u4"), np.empty(2 * len(doc), _U)
        code[::2] = np.concatenate([x[3] for x in held])[pick] << 1
        code[1::2] = code[::2] | 1
        key[::2], key[1::2] = (np.concatenate([x[i] for x in held])[pick] for i in (4, 5))
        order = np.flatnonzero(key)
        order = order[np.argsort(key[order])]
        start, end = _runs(key[order])
        if not len(start):
            return
        low, high = (f.reduceat(doc[order >> 1], start) for f in (np.minimum, np.maximum))
        g = np.flatnonzero(ids[low] < ids[high])
        group = np.full(len(start), -1)
        group[g] = np.arange(len(g))
        group = np.repeat(group, end - start)
        shared, group = order[group >= 0], group[group >= 0]
        several = np.zeros(len(key), bool)
        several[shared] = True
        again = np.flatnonzero(several)
        turn = _turn(key[again], turns)
        for i in range(turns):
            if len(x := again[turn == i]):
                k = ids[doc[x >> 1]]
                yield -1 - int(k[0] % buckets), _pack(_delta(k), ths[doc[x >> 1]], code[x]), bytes([i])
        near = np.flatnonzero(several[::2] | several[1::2])
        context = np.empty(len(doc), _U)
        sizes = [len(x[6]) for x in held]
        place = np.concatenate([x[7] + o for x, o in zip(held, np.cumsum(sizes) - sizes)])[pick]
        context[near] = contexts(b"".join(x[6] for x in held), place[near], length)
        # different contexts of each group, by as many of their bits as one number holds
        pairs = np.argsort(_within(group, context[shared >> 1]))
        group, context = group[pairs], context[shared[pairs] >> 1]
        load = np.bincount(group[_runs(group, context)[0]], minlength=len(g))
        one = np.flatnonzero((key != 0) & ~several)
        g = g[by := np.argsort(low[g])]
        k, th = np.r_[ids[doc[one >> 1]], ids[low[g]]], np.r_[ths[doc[one >> 1]], load[by]]
        code, key = np.r_[code[one], np.full(len(g), _NO_CODE, "<u4")], np.r_[key[one], key[order[start[g]]]]
        bucket = (key >> _U(20)) % _U(buckets)
        order = _stable(bucket, buckets)
        k, th, code, key, bucket = k[order], th[order], code[order], key[order], bucket[order]
        for s, e in zip(*_runs(bucket)):
            yield int(bucket[s]), _pack(_delta(k[s:e]), th[s:e], code[s:e]), _pack(key[s:e])

    def run(batches):
        held: list[tuple] = []
        size = 0
        rows = (row for b in batches for row in zip((t.as_buffer().to_pybytes() for t in b.column(2)), b.column(0).to_pylist(), b.column(1).to_pylist()))
        for named, data, origin, sizes in _blocks(rows, length):
            at, _ = anchors(data, length, origin, sizes)
            count = np.diff(np.searchsorted(at, origin), append=len(at))
            begin = np.repeat(origin, count)
            ids, ths = np.array(named, np.int64).T
            held.append((ids, ths, count, (at - begin).astype("<u4"), *keys(data, at, begin, np.repeat(sizes, count), length), data, at))
            size += len(at)
            if size >= CHUNK_ANCHORS:
                yield _batch(dealt(held))
                held, size = [], 0
        if held and (rows := list(dealt(held))):
            yield _batch(rows)

    return run


def _by_bucket(batches):
    """(bucket, its rows) from batches that are sorted by bucket; negative buckets come row by row."""
    now, rows = None, []
    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now or bucket < 0:
                if rows:
                    yield now, rows
                now, rows = bucket, []
            rows.append(row)
    if rows:
        yield now, rows


def _settle(buckets: int, length: int, turns: int = 1):
    """Reduce side: which sides share their key with another document, and keys with many fragments."""

    def run(batches):
        sides = [_ByDocument(_SIDE, buckets, i) for i in range(turns)]
        for bucket, rows in _by_bucket(batches):
            parts = [_unpack(r[0], "<i8", "<i8", "<u4") for r in rows]
            k = np.concatenate([np.cumsum(p[0]) for p in parts])
            th, code = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            if bucket < 0:
                yield from sides[rows[0][1][0]].add(k, th, code)
                continue
            key = np.concatenate([_unpack(r[1], "<u8")[0] for r in rows])
            order = np.argsort(key)
            start, end = _runs(key[order])
            known = code == _NO_CODE
            shared = np.minimum.reduceat(k[order], start) < np.maximum.reduceat(k[order], start)
            shared |= np.logical_or.reduceat(known[order], start)
            hit = np.empty(len(key), bool)
            hit[order] = np.repeat(shared, end - start)
            hit = np.flatnonzero(hit & ~known)
            turn = _turn(key[hit], turns)
            for i in range(turns):
                x = hit[turn == i]
                yield from sides[i].add(k[x], th[x], code[x])
            load = np.add.reduceat(np.where(known, th, 1)[order], start)
            many = np.flatnonzero(shared & (load >= HOT_FRAGMENTS))
            if len(many):
                n = len(many)
                names = [x.tobytes() for x in key[order[start[many]]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, _HOT, np.int32)), pa.array(load[many]), pa.array(names, pa.binary())], schema=_FOUND)
        for x in sides:
            yield from x.rows()

    return run


def _keys_of(text: np.ndarray, side: np.ndarray, length: int) -> np.ndarray:
    """The keys of fragments, from their bytes; a string that is dealt on its own is its own key."""
    left, right = _sides(length)
    m, width = text.shape
    flat, row = np.ascontiguousarray(text).ravel(), np.arange(m) * width
    out = np.empty(m, _U)
    for own, at, size, salt in ((0, length - GRAM - left, left + GRAM, 0), (1, left - 1, GRAM + right, 1), (_STRING, 0, length, 0)):
        x = np.flatnonzero(side == own)
        if len(x):
            out[x] = _hashed(flat, row[x] + at, size, salt) | _U(1)
    return out


def _merged(key, lo, hi, text) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and the starts in it of runs that are equal byte for byte."""
    m, width = text.shape
    words = np.ascontiguousarray(text).view(_U)
    mixed = _hashed(words.view(np.uint8).ravel(), np.arange(m) * width, width)
    mixed ^= (lo * 1024 + hi).astype(_U) * _MIX[13]
    order = np.argsort(key)
    start, end = _runs(key[order])
    group = np.repeat(np.arange(len(start)), end - start)
    order = order[np.argsort(_within(group, mixed[order]))]
    new = np.zeros(m, bool)
    new[_runs(key[order], mixed[order], lo[order], hi[order])[0]] = True
    # a hash only spares the comparison of bytes where it differs
    again = np.flatnonzero(~new)
    for s in range(0, len(again), BLOCK_PLACES):
        x = again[s : s + BLOCK_PLACES]
        new[x] = (words[order[x]] != words[order[x - 1]]).any(axis=1)
    return order, np.flatnonzero(new)


def _strings(begin, lo, hi, text, length: int) -> tuple[np.ndarray, ...]:
    """Every string of the fragments as a fragment of its own: (fragment, begin, text)."""
    count = np.maximum(0, hi - lo + 1)
    of = np.repeat(np.arange(len(lo)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[of]
    alone = np.zeros((len(of), text.shape[1]), np.uint8)
    alone[:, :length] = text[of[:, None], start[:, None] + np.arange(length)]
    return of, begin[of] + start, alone


def _cut(buckets: int, length: int, hot: np.ndarray):
    """Cuts the fragments of given sides from texts, and deals them by bucket of their key.

    Of equal fragments of a chunk those with the smallest id travel; a larger id repeats all of it.
    hot: keys (sorted) whose fragments are dealt string by string.
    """

    def dealt(held):
        k, th, side, begin, lo, hi, text = (np.concatenate([x[i] for x in held]) for i in range(7))
        if not len(k):
            return
        key = _keys_of(text, side, length)
        split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
        if split.any():
            of, b, alone = _strings(begin[split], lo[split], hi[split], text[split], length)
            of, zero, lone = np.flatnonzero(split)[of], np.zeros(len(of), lo.dtype), np.full(len(of), _STRING, side.dtype)
            parts = (k[of], th[of], lone, b, zero, zero, alone, _keys_of(alone, lone, length))
            k, th, side, begin, lo, hi, text, key = (np.concatenate([x[~split], y]) for x, y in zip((k, th, side, begin, lo, hi, text, key), parts))
        order, start = _merged(key, lo, hi, text)
        low = np.empty_like(k)
        low[order] = np.repeat(np.minimum.reduceat(k[order], start), np.diff(start, append=len(order)))
        again = np.flatnonzero(k > low)
        if len(again):
            ends = [(begin + lo)[again].astype("<u4"), (begin + hi)[again].astype("<u4")]
            yield -1 - int(k[again[0]] % buckets), _pack(_delta(k[again]), th[again], *ends), b""
        x = np.flatnonzero(k == low)
        bucket = ((key[x] >> _U(20)) % _U(buckets)).astype(np.int64)
        by = _stable(bucket, buckets)
        x, bucket = x[by], bucket[by]
        k, th, begin, text = k[x], th[x], begin[x].astype("<u4"), text[x]
        lo, hi, side = (c[x].astype("u1") for c in (lo, hi, side))
        for s, e in zip(*_runs(bucket)):
            yield int(bucket[s]), _pack(_delta(k[s:e]), *(c[s:e] for c in (th, begin, lo, hi, side))), _pack_text(text[s:e])

    def run(batches):
        held: list[tuple] = []
        size, seen = 0, set()
        rows = (row for b in batches for row in zip((t.as_buffer().to_pybytes() for t in b.column(2)), *(b.column(i).to_pylist() for i in (0, 1, 3))))
        for named, data, origin, sizes in _blocks(rows, length):
            fresh = {tuple(row[:2]): i for i, row in enumerate(named)}
            new = np.array([i for name, i in fresh.items() if name not in seen], np.int64)
            seen.update(fresh)
            parts = [np.frombuffer(named[i][2], _ENTRY[_SIDE])["code"] for i in new]
            codes = np.sort((np.repeat(new, [len(x) for x in parts]).astype(_U) << _U(32)) | np.concatenate([*parts, np.empty(0, "<u4")]))
            codes = codes[_runs(codes)[0]]
            ids, ths = np.array([row[:2] for row in named], np.int64).T
            for at in range(0, len(codes), CHUNK_FRAGMENTS):
                doc, code = (codes[at : at + CHUNK_FRAGMENTS] >> _U(32)).astype(np.int64), codes[at : at + CHUNK_FRAGMENTS].astype("<u4")
                x, *cut = fragments(data, code, origin[doc], sizes[doc], length)
                held.append((ids[doc[x]], ths[doc[x]], (code & 1)[x], *cut))
                size += len(x)
                if size >= CHUNK_FRAGMENTS:
                    yield _batch(dealt(held))
                    held, size, seen = [], 0, set(fresh)
        if held and (rows := list(dealt(held))):
            yield _batch(rows)

    return run


def _sorted_strings(low, lo, hi, text, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fragment the first and last start of a string that a smaller id than ``low`` has; -1 if none."""
    m, width = text.shape
    column = np.arange(width + 1)
    t = np.zeros((m, width + 1), np.uint16)
    t[:, :width] = text
    t[:, :width] += 1
    t[np.arange(m), hi + length] = 0  # a separator ends every fragment
    used = (column >= lo[:, None]) & (column <= (hi + length)[:, None])
    fragment, start = np.nonzero(used)
    order, common = suffix_array(t[used], length, start <= hi[fragment])
    fragment, start = fragment[order], start[order]
    s, e = _ends(common < length)
    least = np.repeat(np.minimum.reduceat(low[fragment], s), e - s)
    hit = low[fragment] > least
    return _first_last(m, width, fragment[hit], start[hit])


def _first_last(m: int, width: int, fragment: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.full(m, width), np.full(m, -1)
    np.minimum.at(first, fragment, start)
    np.maximum.at(last, fragment, start)
    return np.where(last < 0, -1, first), last


def _slices(key: np.ndarray):
    """Slices of whole keys (sorted) with SORT_FRAGMENTS fragments at most, where a key allows."""
    at = 0
    for s, e in zip(*_runs(key)):
        if e - at > SORT_FRAGMENTS and s > at:
            yield at, s
            at = s
        if e - at > SORT_FRAGMENTS:
            yield at, e
            at = e
    if at < len(key):
        yield at, len(key)


def _repeated(key, low, lo, hi, text, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``_sorted_strings`` over any number of fragments, in order of keys: strings only occur under one key.

    A key of too many fragments is taken apart: its strings are sorted in slices by their own hash.
    """
    first, last = np.full(len(key), -1), np.full(len(key), -1)
    for s, e in _slices(key):
        if e - s <= SORT_FRAGMENTS:
            first[s:e], last[s:e] = _sorted_strings(low[s:e], lo[s:e], hi[s:e], text[s:e], length)
            continue
        step = max(1, SORT_FRAGMENTS // 8)
        hits: list[list] = [[], []]
        for o in range(text.shape[1] - length + 1):
            # equal strings hold the key's anchor at one place, so each place is a set of its own
            own = np.flatnonzero((lo[s:e] <= o) & (hi[s:e] >= o)) + s
            pieces = [np.pad(text[x, o : o + length], ((0, 0), (0, 8))) for x in np.split(own, list(range(step, len(own), step)))]
            name = np.concatenate([_keys_of(x, np.full(len(x), _STRING), length) for x in pieces])
            order = np.argsort(name, kind="stable")
            own, name = own[order], name[order]
            for p, q in _slices(name):
                x = own[p:q]
                alone = np.zeros((q - p, text.shape[1]), np.uint8)
                alone[:, :length] = text[x, o : o + length]
                zero = np.zeros(q - p, np.int64)
                found = x[_sorted_strings(low[x], zero, zero, alone, length)[1] >= 0]
                hits[0].append(found)
                hits[1].append(np.full(len(found), o))
        first[s:e], last[s:e] = _first_last(e - s, text.shape[1], np.concatenate(hits[0]) - s, np.concatenate(hits[1]))
    return first, last


def _compare(length: int, buckets: int):
    """Reduce side: the spans of every document that a smaller id has too."""
    before, width = length - GRAM, _width(length)

    def run(batches):
        spans = _ByDocument(_SPAN, buckets)
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                parts = [_unpack(r[0], "<i8", "<i8", "<u4", "<u4") for r in rows]
                k = np.concatenate([np.cumsum(p[0]) for p in parts])
                th, first, last = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
                yield from spans.add(k, th, first - np.uint32(before), last - np.uint32(before) + np.uint32(length))
                continue
            parts = [_unpack(r[0], "<i8", "<i8", "<u4", "u1", "u1", "u1") for r in rows]
            k = np.concatenate([np.cumsum(p[0]) for p in parts])
            th, begin, lo, hi, side = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, 6))
            text = np.concatenate([_unpack_text(r[1], width) for r in rows])
            key = _keys_of(text, side, length)
            order, start = _merged(key, lo, hi, text)
            one = order[start]
            low = np.minimum.reduceat(k[order], start)
            first, last = _repeated(key[one], low, lo[one], hi[one], text[one], length)
            of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
            k, th, begin = k[order], th[order], begin[order] - before
            # a larger id than the fragment's smallest repeats all of it, that one what the array found
            more = k > low[of]
            first, last = np.where(more, lo[one][of], first[of]), np.where(more, hi[one][of], last[of])
            hit = last >= 0
            yield from spans.add(k[hit], th[hit], (begin + first)[hit], (begin + last + length)[hit])
        yield from spans.rows()

    return run


def _removed(spans: bytes, n: int) -> np.ndarray:
    """Which bytes of a text the found spans cover."""
    entries = np.frombuffer(spans, _ENTRY[_SPAN])
    edge = np.bincount(entries["from"], minlength=n + 1) - np.bincount(entries["to"], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k, th, entries`` of every document that repeats something; k and th name its row."""
    spark = docs.sparkSession
    n = partitions(spark)
    # buckets are as large as a task can hold; a partition goes through several of them, one by one
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n * max(1, -(-size // (n * BUCKET_BYTES)))
    texts = docs.select(*_row_key(), raw("text").alias("t"))
    dealt = texts.mapInArrow(_deal(buckets, length, TURNS), _DEALT_SQL)
    found = materialize(_dealt(dealt, n, "bucket").mapInArrow(_settle(buckets, length, TURNS), _FOUND_SQL), "candidates")
    hot = found.where(f"kind = {_HOT}").orderBy(F.desc("load"), "data").limit(HOT_KEYS).select("data").collect()
    hot = np.sort(np.frombuffer(b"".join(r.data for r in hot), "<u8"))
    spans = []
    for turn in range(TURNS):
        sides = _dealt(found.where(f"kind = {_SIDE} and load = {turn}"), n, "dest").mapInArrow(_gather(_SIDE), _GATHERED_SQL)
        cut = texts.join(sides, ["k", "th"]).select("k", "th", "t", "entries").mapInArrow(_cut(buckets, length, hot), _DEALT_SQL)
        spans.append(materialize(_dealt(cut, n, "bucket").mapInArrow(_compare(length, buckets), _FOUND_SQL), "spans"))
    discard(found)
    every = functools.reduce(DataFrame.union, spans)
    out = materialize(_dealt(every, n, "dest").mapInArrow(_gather(_SPAN), _GATHERED_SQL), "repeats-by-document")
    discard(*spans)
    return out


def _dealt(df: DataFrame, n: int, by: str) -> DataFrame:
    # a bucket's rows are neighbours; a document's anchors of a bucket share its id then
    return df.repartitionById(n, F.pmod(F.col(by), F.lit(n)).cast("int")).sortWithinPartitions(by)


def _row_key():
    """A document's id, null last, and a hash of its text: rows that repeat an id keep apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64(raw("text")).alias("th")


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with text ``kept`` (bytes).

    * null counts as empty; texts shorter than ``length`` bytes keep everything;
    * only a smaller ``doc_id`` removes: rows that share one leave one another alone, and a null id
      counts as larger than all others;
    * strings are judged on the input, so copies of copies go too; bytes may be cut within a
      character; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    if not GRAM + 8 <= length <= 200:
        raise ValueError("length must lie between 24 and 200 bytes")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * text

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = t.as_buffer().to_pybytes()
                out, kept = np.zeros(len(data), bool), data
                if spans:
                    out = _removed(spans, len(data))
                    kept = np.frombuffer(data, np.uint8)[~out].tobytes()
                runs = int(np.count_nonzero(out[1:] & ~out[:-1]) + (len(out) > 0 and out[0]))
                row = [doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()]
                rows.append(row + [kept] * text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    texts = docs.select(F.col("doc_id").cast("long"), *_row_key(), raw("text").alias("t"))
    joined = texts.join(find_repeats(docs, length), ["k", "th"], "left").select("doc_id", "t", "entries")
    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text
    )


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
