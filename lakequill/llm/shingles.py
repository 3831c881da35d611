"""Word shingles of whole texts as sorted 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed at a time; a longer document makes a block of its own.
BLOCK = 1 << 20


#: Bytes up to which words are hashed together, eight bytes at a time; longer ones each by a keyed digest.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts_at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in data (UTF-8 bytes of documents laid end to end), and how many words begin before each offset in starts_at.

    A word's bytes go through the mixing function eight at a time, each step's result into the next, from a start that
    seed and length make: no sum of terms, so words with equal letters in other places don't cancel out.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts_at), np.int64)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[data]
    word = ~_SEP[low[:n]]
    cut = np.zeros(n + 1, bool)
    cut[starts_at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = e - s
    eights = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # eight bytes from every place on
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ start)
        rows = np.flatnonzero(size <= LONG_WORD)
        left, at = size[rows], s[rows]
        while len(rows):
            h[rows] = mix(h[rows] ^ (eights[at] & _KEEP[np.minimum(left, 8)])) + start
            more = np.flatnonzero(left > 8)
            rows, left, at = rows[more], left[more] - 8, at[more] + 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h, np.searchsorted(s, starts_at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, seed: int = 0):
    """Yield, for each document between neighbouring offsets, the sorted distinct hashes of its width-word shingles; of fewer words the whole sequence is one; without words none."""
    total = len(offsets) - 1
    i = 0
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    odd = [np.uint64((0xA0761D6478BD642F * (2 * k + 1) ^ (0xE7037ED1A0B428DB * k)) & (2**64 - 1) | 1) for k in range(width)]
    while i < total:
        j = i + 1
        while j < total and offsets[j + 1] - offsets[i] <= BLOCK:
            j += 1
        at = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        w, first = word_hashes(data[offsets[i] : offsets[j]], at, seed)
        with np.errstate(over="ignore"):
            long = len(w) - width + 1
            if long > 0:
                h = np.full(long, salt, np.uint64)
                for k in range(width):
                    h += mix(w[k : k + long] + odd[k]) * odd[k]
                h = mix(h)
            for d in range(j - i):
                a, b = first[d], first[d + 1]
                if b - a >= width:
                    x = np.sort(h[a : b - width + 1])
                    yield x[np.concatenate(([True], x[1:] != x[:-1]))]
                elif b > a:
                    x = np.array([salt ^ np.uint64(int(b - a))], np.uint64)
                    for k in range(b - a):
                        x += mix(w[a + k : a + k + 1] + odd[k]) * odd[k]
                    yield mix(x ^ np.uint64(0x5851F42D4C957F2D))
                else:
                    yield np.zeros(0, np.uint64)
        i = j


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    import pyarrow as pa

    if hasattr(col, "combine_chunks"):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def set_signature(x: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit hashes of a sorted set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(x))
        a = mix(mix(x * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + n)
        b = mix(mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) * np.uint64(0x165667B19E3779F9) + n)
    return int(a >> np.uint64(1)), int(b >> np.uint64(1))


def parities(x: np.ndarray) -> np.ndarray:
    """256 bits of a set as four signed longs: each the parity of how many members fall on it. The bits in which two sets' differ are at most as many as the members in which the sets do."""
    bits = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(bits).view("<i8")
