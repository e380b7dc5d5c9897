"""Text kernels over Arrow buffers: words and n-grams hashed without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A polynomial's base and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that a kernel works on at a time; a longer text is worked on alone.
CHUNK = 1 << 20
#: Most texts of a chunk, as a power of two and a number.
TEXT_BITS = 12
TEXTS = 1 << TEXT_BITS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower: bool = False) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


class Powers:
    """Powers of BASE and of its inverse, for ``least`` bytes and grown as longer chunks come."""

    def __init__(self, least: int = CHUNK):
        self.least = least
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, self.least + 1)
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE)]).cumprod()
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, INVERSE)]).cumprod()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, limit: int = CHUNK):
    """Runs [i, j) of texts of about ``limit`` bytes together, at most TEXTS of them."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + TEXTS)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, rel: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the words of texts that lie end to end; ``rel``: n + 1 offsets from 0."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    at = rel[:-1]
    at = at[at < n]
    first[at] = ink[at]
    at = rel[1:] - 1
    at = at[at >= 0]
    last[at] = ink[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(rel, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, codes: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    powers.reach(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * powers.up[:n], out=total[1:])
    return mix((total[e] - total[s]) * powers.down[s] + (e - s).astype(np.uint64))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within each text, and each text's offsets into them.

    A text of fewer than ``k`` words, but at least one, gives its whole
    sequence as one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    off = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(off[-1], np.uint64)
    if len(words) >= k:
        acc = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            acc = mix(acc + words[i : len(words) - k + 1 + i])
        full = count >= k
        reps = np.repeat(np.flatnonzero(full), made[full])
        inner = np.arange(len(reps)) - np.repeat(np.concatenate([[0], np.cumsum(made[full])])[:-1], made[full])
        out[off[reps] + inner] = acc[begin[reps] + inner]
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(count[d])
        for w in words[begin[d] : begin[d + 1]]:
            h = mix(np.array([h ^ w]))[0]
        out[off[d]] = h
    return out, off


def letter_table() -> np.ndarray:
    """Bytes as letters: A-Z in lower case, other ASCII than letters as a space, the rest as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 0x20
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def letter_stream(part: np.ndarray, rel: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with one space for each run of other characters, and n + 1 bounds.

    Text d stands between the spaces at ``bounds[d]`` and ``bounds[d + 1]``.
    """
    x = table[part]
    if len(x) > 1:  # capitals of Latin-1 in UTF-8
        up = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        x[1:][up] |= 0x20
    x = np.insert(x, rel, 0x20)
    at = rel + np.arange(len(rel))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    keep[at] = True
    return x[keep], (np.cumsum(keep) - 1)[at]


def byte_grams(x: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``n`` bytes within a text as a number, and the text's index; n is at most 7."""
    if len(x) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        g <<= np.uint64(8)
        g |= x[i : len(x) - n + 1 + i]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(g)]
    ok = np.arange(len(g)) + n - 1 <= bounds[doc + 1] if len(g) == len(doc) else np.arange(len(doc)) + n - 1 <= bounds[doc + 1]
    return g[: len(doc)][ok], doc[ok]


def distinct(a: np.ndarray) -> np.ndarray:
    """Ascending, each once."""
    a = np.sort(a)  # several times faster for plain numbers than np.unique
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new]


def gram_pairs(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of at most 6 bytes with each text of a chunk that has it, by gram."""
    key = distinct(g << np.uint64(TEXT_BITS) | doc.astype(np.uint64))
    return key >> np.uint64(TEXT_BITS), (key & np.uint64(TEXTS - 1)).astype(np.int64)


def counted(arrays: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order and how often each is there, or its sum of whole weights."""
    if not arrays:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.concatenate(arrays)
    order = np.argsort(a, kind="stable") if weights is not None else None
    a = np.sort(a) if order is None else a[order]
    at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    if order is None:
        return a[at], np.diff(np.append(at, len(a)))
    return a[at], np.add.reduceat(np.concatenate(weights).astype(np.int64)[order], at) if len(a) else np.zeros(0, np.int64)
