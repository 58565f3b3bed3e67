"""Vectorised words and hashes of many texts at once; small helpers that run inside Spark's Arrow tasks.

A word is a run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``, which is what ``bytes.split()`` yields.
Hashes are polynomial (Rabin-Karp) hashes modulo 2**64 over a random byte table, finished with a mixer. Modulo a power of
two there are pairs of long words with equal hashes for every base, so words above ``LONG_WORD`` bytes have a digest instead.
They do not depend on the process, so a task that is run again gives the same values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
LONG_WORD = 32

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    up, down = _powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(base, -1, 1 << 64)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, b in ((up, base), (down, inverse)):
            out[0] = 1
            k = 1
            while k < size:
                out[k : 2 * k] = out[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
        _powers[base] = up, down
    return up, down


def _slice_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of all words, and a 64-bit hash of each."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not _SPACE[data[end]]:  # a cut falls on white space
            end += 1
        if end - at > 2 * SLICE:  # one giant word: everything before it, then the word itself
            begin = max(data.rfind(c, at, at + SLICE) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
            if begin > at:
                end = begin
            else:
                out.append((np.array([at]), np.array([end]), np.array([digest(data[at:end])], np.uint64)))
                at = end
                continue
        s, e, h = _slice_words(data[at:end])
        for k in np.flatnonzero(e - s > LONG_WORD):
            h[k] = digest(data[at + s[k] : at + e[k]])
        out.append((s + at, e + at, h))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, a line end after each, and the offset at which each begins (one more at the end)."""
    texts = [t or b"" for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return b"\n".join(texts) + (b"\n" if texts else b""), bounds


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of the ``width`` words from each position, as differences of prefix sums."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(_WINDOW_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows that lie in one text; ``first`` has each text's first word, and the end."""
    all_of = window_hashes(hashes, width)
    keep = np.repeat(first[1:], np.diff(first))[: len(all_of)] - np.arange(len(all_of)) >= width
    at = np.flatnonzero(keep)
    return at, all_of[at]


def pack(values: np.ndarray) -> bytes:
    """Non-decreasing unsigned numbers as zstd over the byte planes of their differences."""
    v = np.asarray(values, np.uint64)
    d = np.diff(v, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(v) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray, kind: type) -> bytes:
    """Numbers in any order as zstd over their byte planes."""
    v = np.ascontiguousarray(values, kind)
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes(), codec="zstd", asbytes=True) if len(v) else b""


def expand(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash space, so that sorted hashes of a bucket stay close together."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def hashed_ids(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column, for values that a task and a DataFrame must place alike."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = np.ascontiguousarray(ids, np.int64).view(np.uint64) * two
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * one
    h = np.uint64(42 + 8) + five ^ x
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)
