"""Whole texts as numpy arrays: words and their hashes straight from the UTF-8 bytes of an Arrow column.

Work goes in blocks of about a megabyte. What is held beside is the Arrow batch that Spark hands over (bounded by rows and by spark.sql.execution.arrow.maxBytesPerBatch, or one text) and, for sets of shingles, one text's hashes.
Character n-grams are read in pieces of texts, so there no text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64, copy=False)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, space


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def groups(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spaced(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j with A-Z lower-cased and a space between texts; and where each begins."""
    lower, _ = _tables()
    lengths = np.diff(at[i : j + 1])
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(int(begin[-1]), 32, np.uint8)
    for k in range(j - i):
        out[begin[k] : begin[k] + lengths[k]] = data[at[i + k] : at[i + k + 1]]
    return lower[out], begin[:-1]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the start of each word, a word being a run of anything but ASCII whitespace."""
    _, space = _tables()
    hashes, starts, at, n = [], [], 0, len(buffer)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not space[buffer[end]]:  # words stay whole
            stop = np.flatnonzero(space[buffer[end : end + 4096]])
            end = min(n, end + (int(stop[0]) if len(stop) else 4096))
        part = buffer[at:end]
        word = np.zeros(len(part) + 2, bool)
        np.logical_not(space[part], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        s, e = edges[::2], edges[1::2]
        if len(s):
            up, down = _powers(1 << max(20, int(len(part)).bit_length()))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + _U(1)) * up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s]))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def words_by_row(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows i to j, and the bounds of each row among them."""
    buffer, begin = spaced(data, at, i, j)
    hashes, starts = word_hashes(buffer)
    return hashes, np.concatenate((np.searchsorted(starts, begin), [len(hashes)]))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one hash of all; of none, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    m = min(n, k)
    total = np.zeros(n - m + 1, np.uint64)
    for step in range(m):
        total += mix(words[step : n - m + 1 + step], step + 1 + 16 * m)
    return np.unique(mix(total, m))


@lru_cache(maxsize=2)
def _kept(kind: str) -> np.ndarray:
    """For each code point, its lower case if it is a letter (kind "alpha") or a letter or digit ("alnum"), else 0."""
    keep = str.isalpha if kind == "alpha" else str.isalnum
    out = np.zeros(0x110000, np.uint32)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        for n in range(start, stop):
            c = chr(n)
            if keep(c):
                low = c.lower()
                out[n] = ord(low) if len(low) == 1 else n
    return out


def code_points(texts: list[str | None], kind: str = "alnum") -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the kept kind, 0 for all others and before and after each text; and each text's bounds, the zero before it included."""
    raw = "\0" + "\0".join(t or "" for t in texts) + "\0"
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    return _kept(kind)[np.minimum(codes, 0x10FFFF)], np.concatenate(([0], np.cumsum(lengths)))


def pieces(texts: list[str | None], size: int, before: int, after: int) -> Iterator[tuple[list[tuple[int, bool]], np.ndarray, np.ndarray, list[str]]]:
    """Texts in groups of at most `size` code points, long ones cut: for each piece its text's place and whether it is the text's last, and the pieces' strings with `before` and `after` neighbours at
    a cut, from how many characters in they count themselves, and how many count."""
    held: list[tuple[int, int, int]] = []
    room = size

    def group() -> tuple[list[tuple[int, bool]], np.ndarray, np.ndarray, list[str]]:
        own = [texts[k] or "" for k, _, _ in held]
        skip = np.array([min(a, before) for _, a, _ in held], np.int64)
        return [(k, b >= len(t)) for (k, _, b), t in zip(held, own)], skip, np.array([b - a for _, a, b in held], np.int64), [t[a - min(a, before) : b + after] for (_, a, b), t in zip(held, own)]

    for k, t in enumerate(texts):
        n, a = len(t or ""), 0
        while True:
            b = min(n, a + room)
            if b < n and a == 0 and n <= size:  # fits the next group whole
                b = 0
            else:
                held.append((k, a, b))
            room -= b - a + 1
            if b < n:
                yield group()
                held, room, a = [], size, b
                continue
            if room <= 0:
                yield group()
                held, room = [], size
            break
    if held:
        yield group()
