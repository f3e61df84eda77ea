"""Vectorised word and shingle hashing over batches of whole texts.

Words are maximal runs of bytes outside a separator set, after lower-casing A-Z.  The 64-bit hash of a
word is a polynomial in its bytes, read from prefix sums over the whole buffer, so that no Python code
runs per word.  Everything is deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_MULT, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
#: One random 64-bit value for each byte.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Separators: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators: everything but digits, letters and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Texts are taken in groups of about so many bytes; a longer text forms a group alone.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (_MULT, _INV):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Yields (index of the first text, lower-cased UTF-8 texts) in groups of bounded size; null is empty."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        if part and size + len(b) > GROUP_BYTES:
            yield at, part
            at, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield at, part


def words(part: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash of each word, index of the first word of each text and the end, start bytes, end bytes, buffer)."""
    buffer = b" ".join([*part, b""])
    a = np.frombuffer(buffer, np.uint8)
    lengths = np.fromiter((len(b) + 1 for b in part), np.int64, len(part))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    if not len(a):
        return np.zeros(0, U64), np.zeros(len(part) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), buffer
    inside = ~separators[a]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(a) + 1)
    prefix = np.empty(len(a) + 1, U64)
    prefix[0] = 0
    np.cumsum(_BYTE[a] * power[: len(a)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts]), np.searchsorted(starts, begin), starts, ends, buffer


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, its text, its first word).  A text of 1 to width-1 words has one shingle: all its words."""
    n = np.diff(first)
    full = np.zeros(0, U64)
    if len(h) >= width:
        full = np.zeros(len(h) - width + 1, U64)
        for k in range(width):
            full = full * U64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
        full = mix(full)
    many = np.maximum(n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
    out, at_word = full[at] if len(at) else np.zeros(0, U64), at - first[text] if len(at) else at
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        more = np.fromiter((_sequence(h[first[i] : first[i + 1]]) for i in short), U64, len(short))
        out, text, at_word = np.concatenate([out, more]), np.concatenate([text, short]), np.concatenate([at_word, np.zeros(len(short), np.int64)])
        order = np.argsort(text, kind="stable")
        out, text, at_word = out[order], text[order], at_word[order]
    return out, text, at_word


def _sequence(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0xD6E8FEB86659FD93 + v + 1) & _MASK
    return int(mix(np.array([x], U64))[0])


def distinct_sets(values: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct values of each of n texts; text is ascending."""
    cut = np.searchsorted(text, np.arange(n + 1))
    return [np.unique(values[cut[i] : cut[i + 1]]) for i in range(n)]
