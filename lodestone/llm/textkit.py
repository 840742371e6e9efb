"""Numpy kernels over the text buffers of Arrow batches.

Everything works on whole batches: a batch's texts are one array of code points
(or bytes) with the offsets of the documents, so that no Python loop runs per
word or per shingle.  Batches are cut at document borders into chunks of about
``CHUNK`` bytes; one longer document is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
U64 = np.uint64
_STATE: dict = {}


def state(key, build):
    """Kept between tasks of a worker; one entry."""
    if _STATE.get("key") != key:
        begin()
        _STATE.update(key=key, value=build())
    return _STATE["value"]


def begin() -> None:
    """For tasks without a state: drop what another operator's tasks left in this worker, and give freed memory back."""
    _STATE.clear()
    _trim()


def _trim() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run):
    """``run`` over batches, giving freed memory back as it ends: a worker that waits for its next task holds none of it."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (xor-shift and multiply, 64 bits)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def chunks(texts: pa.Array, limit: int = CHUNK):
    """(first, last, bytes, offsets) for runs of documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_binary() if texts.type == pa.binary() else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if texts.type == pa.large_string() else b"")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the documents' offsets among them."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, offsets
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cps, lead[offsets]


def utf8_lengths(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space; by code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = np.arange(0x110000, dtype=np.uint32)
    everything = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
    for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        hit = "".join(regex.findall(p, everything))
        out[np.frombuffer(hit.encode("utf-32-le"), np.uint32)] = k
    return out


def pretokens(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the matches of the byte-level BPE pattern; matches never cross documents.

    The pattern's alternatives only depend on runs of equal class, on one space
    before a run and on an apostrophe at a match's start, so they are found by
    comparing neighbours.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # offsets may name n
    inner = ~first[:n]  # has a predecessor in its document
    run = ~inner
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == 3
    start = run.copy()
    # the last white space before other text starts a match: alone, or with that text if it is a plain space
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & inner[1:]
    start |= last
    taken = np.zeros(n, bool)
    taken[1:] = last[:-1] & (cps[:-1] == 0x20)
    start &= ~taken
    # contractions
    at = np.flatnonzero((cps == 0x27) & start)
    if len(at):
        at = at[at + 1 < n]
        at = at[inner[at + 1]]
        one = cps[at + 1]
        two = np.where((at + 2 < n) & inner[np.minimum(at + 2, n - 1)], cps[np.minimum(at + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ~single & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((at[single], 2), (at[double], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < n]
            after = after[inner[after] & (cls[after] == 1)]
            start[after] = True
    return np.flatnonzero(start)


def _stir(h: np.ndarray) -> np.ndarray:
    """A lighter mixer, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint spans of ``values`` (code points or bytes), in order; equal where the spans are.

    Every value is mixed with its place in its span before it is added up, so that no regular
    pair of texts cancels out, as it can in a polynomial modulo 2**64.
    """
    n = len(values)
    with np.errstate(over="ignore"):
        first = np.zeros(n, np.int64)
        real = starts < n
        first[starts[real]] = starts[real]
        np.maximum.accumulate(first, out=first)
        v = (np.arange(n) - first).astype(U64)
        v *= U64(0x9E3779B97F4A7C15)
        v += (values.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F)
        _stir(v)
        p = np.zeros(n + 1, U64)
        np.cumsum(v, out=p[1:])
        return mix((p[ends] - p[starts]) ^ ((ends - starts).astype(U64) << U64(48)))


class Windows:
    """Hashes of overlapping spans of bytes: those of 8, 16, 32, ... bytes from every place, each mixed from two of half the size."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.levels: dict[int, np.ndarray] = {}

    def level(self, size: int) -> np.ndarray:
        if size not in self.levels:
            with np.errstate(over="ignore"):
                if size == 8:
                    h = np.ndarray((len(self.raw) - 7,), "<u8", np.ascontiguousarray(self.raw), strides=(1,)).astype(U64)
                else:
                    half = self.level(size // 2)
                    h = half[: len(half) - size // 2] * U64(0x9E3779B97F4A7C15)
                    h += half[size // 2 :]
                self.levels[size] = _stir(h)
        return self.levels[size]

    @staticmethod
    def _base(least: int) -> int:
        size = 8
        while size * 2 <= least:
            size *= 2
        return size

    def every(self, width: int) -> np.ndarray:
        """Hashes of the ``width`` bytes (8 at least) from every place."""
        size = self._base(width)
        h = self.level(size)
        if size == width:
            return mix(h)
        with np.errstate(over="ignore"):
            return mix(h[: len(self.raw) - width + 1] * U64(0xA0761D6478BD642F) + h[width - size :])

    def spans(self, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """Hashes of spans of ``least`` bytes (8 at least) or more, which may overlap."""
        if not len(starts):
            return np.zeros(0, U64)
        size = self._base(least)
        h = self.level(size)
        with np.errstate(over="ignore"):
            out = mix((ends - starts).astype(U64))
            for k in range(-(-int((ends - starts).max()) // size)):
                use = np.flatnonzero(starts + k * size < ends)
                at = np.minimum(starts[use] + k * size, ends[use] - size)
                out[use] = mix(out[use] * U64(0xA0761D6478BD642F) + h[at])
        return out


class HashIndex:
    """Open addressing from 64-bit hashes to consecutive numbers, vectorised."""

    def __init__(self, size: int = 1 << 16):
        self.bits = max(10, int(size * 2 - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, U64)
        self.vals = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        slot, mask = self._slots(h), (1 << self.bits) - 1
        todo = None
        hh = h
        while True:
            v = self.vals[slot]
            hit = (self.keys[slot] == hh) & (v >= 0)
            if todo is None:
                out[hit] = v[hit]
                todo = np.flatnonzero(~hit & (v >= 0))
                slot, hh = slot[todo], h[todo]
            else:
                out[todo[hit]] = v[hit]
                left = ~hit & (v >= 0)
                todo, slot, hh = todo[left], slot[left], hh[left]
            if not len(todo):
                return out
            slot = (slot + 1) & mask

    def add(self, h: np.ndarray) -> None:
        """Hashes that are new and distinct; they get the next numbers in order."""
        if (self.n + len(h)) * 2 > 1 << self.bits:
            self._grow(self.n + len(h))
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _grow(self, size: int) -> None:
        full = self.vals >= 0
        keys, vals = self.keys[full], self.vals[full]
        self.bits = int(size * 3 - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, U64)
        self.vals = np.full(1 << self.bits, -1, np.int32)
        self._put(keys, vals)

    def _put(self, h: np.ndarray, num: np.ndarray) -> None:
        slot, mask = self._slots(h), (1 << self.bits) - 1
        while len(h):
            free = self.vals[slot] < 0
            self.vals[slot[free]] = num[free]  # the last writer of a slot wins
            won = free & (self.vals[slot] == num)
            self.keys[slot[won]] = h[won]
            left = ~won
            h, num, slot = h[left], num[left], slot[left]
            slot = np.where(self.vals[slot] >= 0, (slot + 1) & mask, slot)


def gather(offsets: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated lists ``which`` of a list column, and the offsets of the result."""
    sizes = offsets[which + 1] - offsets[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    idx = np.repeat(offsets[which] - out[:-1], sizes)
    idx += np.arange(out[-1])
    return values[idx], out


class WordLists:
    """A growing map from word hashes to lists of ids, with a bound after which it starts afresh from its base."""

    def __init__(self, hashes=(), offsets=None, values=None, most: int = 1_000_000):
        self.base = (np.asarray(hashes, U64), offsets, values)
        self.most = most
        self.reset()

    def reset(self) -> None:
        h, off, val = self.base
        self.index = HashIndex(max(1 << 16, len(h)))
        self.index.add(h)
        self.off = np.zeros(1, np.int64) if off is None else off.astype(np.int64)
        self.val = np.zeros(0, np.int32) if val is None else val.astype(np.int32)
        self.new_off, self.new_val = [], []

    def lists(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """ids and offsets for each hash; ``encode(first positions)`` gives (offsets, ids) for those unknown."""
        if self.index.n > self.most + len(self.base[0]):
            self.reset()
        which = self.index.get(hashes)
        miss = np.flatnonzero(which < 0)
        if len(miss):
            new, at = np.unique(hashes[miss], return_index=True)
            off, val = encode(miss[at])
            self.index.add(new)
            self.off = np.concatenate((self.off, self.off[-1] + off[1:]))
            self.val = np.concatenate((self.val, val.astype(np.int32)))
            which[miss] = self.index.get(hashes[miss])
        return gather(self.off, self.val, which)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the offsets of each document's words."""
    n = len(raw)
    gap = np.ones(n + 1, bool)
    gap[:n] = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    solid = ~gap
    start = solid.copy()
    start[1:] &= gap[:-1] | first[1:]
    s = np.flatnonzero(start)
    end = solid[:-1] & (gap[1:] | first[1:])
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` words in a row, and each document's offsets.

    A document of 1 to k-1 words has one shingle, of all its words; one without words has none.
    """
    s, e, at = words(raw, offsets)
    if not len(s):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        w = span_hashes(raw, s, e)
        n = np.diff(at)
        short = np.minimum(n, k)
        count = np.where(n > 0, n - short + 1, 0)
        out = np.zeros(len(offsets), np.int64)
        np.cumsum(count, out=out[1:])
        idx = np.repeat(at[:-1] - out[:-1], count) + np.arange(out[-1])
        size = np.repeat(short, count)
        h = np.zeros(len(idx), U64)
        for j in range(k):
            use = size > j
            h = np.where(use, (h * U64(0xA0761D6478BD642F)) ^ w[np.minimum(idx + j, len(w) - 1)], h)
            h ^= h >> U64(29)
        return mix(h ^ size.astype(U64)), out
