"""Words and word windows of Arrow text columns, as numpy arrays over whole chunks of rows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur
inside a longer character, so byte runs and code point runs are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

# Rows are worked on in chunks of about this many bytes, so memory does not follow the batch size. Work on
# a chunk takes over twenty times its bytes, and an executor's workers keep much of that for later tasks.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20))
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
# Two unrelated hashes of a word start from these; words of more than LONG bytes are hashed by a digest function.
_SEEDS = _RNG.integers(1, 2**64, size=2, dtype=np.uint64)
LONG = 64
# Sequences are hashed by polynomials modulo a prime, in two unrelated bases.
PRIME = (1 << 61) - 1
_BASES = [int(x) for x in _RNG.integers(1 << 32, PRIME, size=2, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo PRIME of values below it, from products of their halves."""
    half, low30 = np.uint64(31), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> half, a & np.uint64((1 << 31) - 1), b >> half, b & np.uint64((1 << 31) - 1)
    mid, low = ah * bl + al * bh, al * bl
    total = np.uint64(2) * ah * bh + (mid >> np.uint64(30)) + ((mid & low30) << half) + (low & np.uint64(PRIME)) + (low >> np.uint64(61))
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i up to n, doubled from what is known."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) <= n:
        known = np.concatenate([known, _times(known, np.uint64(pow(base, len(known), PRIME)))])
    _POWERS[base] = known
    return known


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row is a range of its own."""
    _, off = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
    # Workers are kept for later tasks; what this batch needed goes back to the machine.
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """All words of a chunk in order: byte spans, the row each belongs to, and two unrelated 64-bit hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row its first word; one more entry at the end

    @cached_property
    def hash2(self) -> np.ndarray:
        return _hash(self.data, self.starts, self.ends, 1)

    def of(self, row: int) -> slice:
        return slice(self.first[row], self.first[row + 1])

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1 joined by one space."""
        cut = self.data[self.starts[lo]:self.ends[hi - 1]].tobytes() if hi > lo else b""
        return b" ".join(cut.split())  # bytes.split() cuts at exactly the six white-space bytes


def split(column: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    data, off = text_bytes(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    rows = len(off) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    row = np.searchsorted(off, starts, "right") - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(data, starts, ends, row, _hash(data, starts, ends, 0) if hashes else np.zeros(0, np.uint64), first)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hashes of byte spans: eight bytes after the other are mixed into a state that starts from the length."""
    size = (ends - starts).astype(np.uint64)
    state = mix(size ^ _SEEDS[which])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = size[at] - np.uint64(k)
        part = blocks[starts[at] + k]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * np.uint64(8))) - np.uint64(1)
        state[at] = mix((state[at] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8, salt=bytes([which])).digest()
        state[i] = np.frombuffer(digest, "<u8")[0]
    return state


def windows(w: Words, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words inside one row, from either word hash."""
    each = w.hash2 if which else w.hash
    total = len(each) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(total, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + each[i:i + total]
    at = np.flatnonzero(w.row[:total] == w.row[n - 1:])
    return at, mix(h[at])


def digest(values: np.ndarray, which: int = 0) -> int:
    """A 64-bit sum (as a signed integer) that stands for a set or, with positions mixed in, a sequence.

    For 128 bits take it of both hashes of the same things.
    """
    with np.errstate(over="ignore"):
        salted = values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x13198A2E03707344) if which else values ^ np.uint64(0x243F6A8885A308D3)
        return int(mix(salted).sum(dtype=np.uint64).astype(np.int64))


def spans(w: Words, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit hashes of each run of words lo to hi - 1, from differences of prefix sums."""
    out = []
    for values, base in ((w.hash, _BASES[0]), (w.hash2, _BASES[1])):
        up, down = _powers(base, len(values)), _powers(pow(base, -1, PRIME), len(values))
        terms = _times(_reduced(mix(values)), up[:len(values)])
        # Halves are summed apart, so that no sum leaves 64 bits.
        high, low = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (terms >> np.uint64(31), terms & np.uint64((1 << 31) - 1)))
        sums = _reduced(_times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))
        run = _times(_reduced(sums[hi] + np.uint64(PRIME) - sums[lo]), down[lo])
        out.append(mix(run ^ ((hi - lo).astype(np.uint64) << np.uint64(40))).view(np.int64))
    return out[0], out[1]
