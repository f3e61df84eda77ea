"""Byte-level BPE encoding and decoding (operator 1).

A text is cut into pieces by the tokenizer's pattern; every piece that is no token itself is merged with a
segment tree over its byte positions.  A leaf holds (rank of the pair that begins there, position), so the
root is the leftmost pair of least rank; a merge changes at most three leaves, each in logarithmic time.  Very
long pieces thus cost n log n.  Short pieces that are new to a worker are merged together, one merge of each at
a time, their trees being the rows of one array; encoded pieces are kept in a cache of bounded size.

Null texts count as empty and give no ids.  Repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basaltql.llm.common import arrow_pass, id_and_text

_NONE = 1 << 62
_LOW = (1 << 32) - 1
#: Pieces whose ids a worker remembers; longer pieces than CACHED_BYTES are never remembered.
CACHE_PIECES, CACHED_BYTES = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: again and again the leftmost adjacent pair of least rank is merged."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            tree[i] = a if a < b else b

    while (least := tree[1]) != _NONE:
        i = least & _LOW
        j = after[i]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, _NONE)
        r = None
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
        put(i, _NONE if r is None else r << 32 | i)
        if (p := before[i]) >= 0:
            r = get(piece[p:k])
            put(p, _NONE if r is None else r << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PieceForest:
    """Merges many short pieces at once: row r of every array is the segment tree of piece r."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        pairs = {}
        for b, rank in ranks.items():
            for cut in range(1, len(b)):
                left, right = get(b[:cut]), get(b[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        #: Ranks of pairs of single bytes, which make all first leaves.
        self.first = np.array([get(bytes([i >> 8, i & 255]), -1) for i in range(1 << 16)], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves: rank and position, or _NONE where the pair is no token."""
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0), self.rank[i] << 8 | at, _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed; pieces have 1 to CACHED_BYTES bytes."""
        out: list[bytes] = [b""] * len(pieces)
        order: dict[int, list[int]] = {}
        for i, b in enumerate(pieces):
            order.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        for size, chosen in order.items():
            for at in range(0, len(chosen), 1 << 14):
                part = chosen[at : at + (1 << 14)]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(b.ljust(size, b"\0") for b in pieces), np.uint8).reshape(m, size)
        inside = np.arange(size) < n[:, None]
        ids = np.full((m, size + 1), -1)
        ids[:, :-1] = np.where(inside, self.byte[raw], -1)
        after = np.tile(np.arange(1, size + 2), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        leaves = np.full((m, size), _NONE)
        rank = self.first[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        leaves[:, :-1] = np.where(inside[:, 1:] & (rank >= 0), rank << 8 | np.arange(size - 1), _NONE)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        flat = [x.reshape(-1) for x in levels]
        flat_ids, flat_after, flat_before = ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.flatnonzero(flat[-1] < _NONE)
        while len(rows):
            least = flat[-1][rows]
            i, new = least & 255, least >> 8
            at = rows * (size + 1)
            j = flat_after[at + i]
            k = np.minimum(flat_after[at + j], size)
            p = flat_before[at + i]
            flat_ids[at + i], flat_ids[at + j] = new, -1
            flat_after[at + i], flat_before[at + k] = k, i
            leaf = rows * size
            flat[0][leaf + j] = _NONE
            flat[0][leaf + i] = self._pair(new, flat_ids[at + k], i)
            has = np.flatnonzero(p >= 0)
            flat[0][(leaf + p)[has]] = self._pair(flat_ids[(at + p)[has]], new[has], p[has])
            spots = np.concatenate([leaf + i, leaf + j, (leaf + p)[has]])
            for low, high in zip(flat, flat[1:], strict=False):
                spots >>= 1  # widths are powers of two, so halving a flat index leads to the parent
                high[spots] = np.minimum(low[2 * spots], low[2 * spots + 1])
            rows = rows[flat[-1][rows] < _NONE]
        live = ids[:, :-1] >= 0
        packed, ends = ids[:, :-1][live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)).tolist()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.find = regex.compile(pattern).findall
        token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            token[i] = b
        self.blob = np.frombuffer(b"".join(token), np.uint8)
        self.length = np.array([len(b) for b in token])
        self.begin = np.cumsum(self.length) - self.length
        self.forest = PieceForest(ranks)
        self.cache: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(t) for t in texts]
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        known, ranks, long = self.cache, self.ranks, {}
        fresh: list[tuple[str, bytes]] = []
        for p in {p for pieces in found for p in pieces}.difference(known):
            b = p.encode("utf-8", "replace")
            if (i := ranks.get(b)) is not None:
                known[p] = i.to_bytes(4, "little")
            elif len(b) <= CACHED_BYTES:
                fresh.append((p, b))
            else:
                long[p] = b"".join(i.to_bytes(4, "little") for i in merge_piece(b, ranks))
        known.update(zip((p for p, _ in fresh), self.forest.merge([b for _, b in fresh]), strict=True))
        if long:
            return [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in found]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def encode_packed(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from one table."""
        ids = np.asarray(ids, np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is no token")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[ids] - ends + n, n)].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each file and pattern in a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about a million characters; null is empty."""
    part, size = [], 0
    for i, t in enumerate(b.column(1)):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= 1_000_000 or i == b.num_rows - 1:
            yield i + 1 - len(part), part
            part, size = [], 0


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), of every whole text."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for at, texts in _parts(b):
            packed = c.encode_all(texts)
            offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in packed)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], ["doc_id", "ids"])

    return arrow_pass(docs, id_and_text(), "doc_id long, ids array<int>", batch)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of every whole text and of what they decode to."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        n, ids, back = [], [], []
        for _, texts in _parts(b):
            for packed in c.encode_all(texts):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(np.frombuffer(packed, "<u4"))).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_pass(docs, id_and_text(), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", batch)
