"""Repeated passages across documents (operator 10), by seeding, collinear chaining and alignment.

1. Every document's words (lower-cased A-Z) give hashes of k words in a row; of each WINDOW successive ones the
   least is a seed, so an exact match of k + WINDOW - 1 words always shares a seed.  All occurrences count.
2. An occurrence is matched, at each of five levels, with the least (doc_id, place) of all documents among the
   occurrences of the same seed, of the same seed with the same SIDE words after it, or before it, and with the same
   SIDE and WIDE words after it, or before it; matches with the document itself are none.  Every level names one
   partner, so no group is expanded into pairs, and nothing depends on batches or partitions.  An exact passage of
   k + WINDOW + WIDE words or more lies in matches of the two widest levels from its first to its last seed, whatever
   else holds parts of it.
3. Occurrences meet by a shuffle on the seed.  Frequent keys (of any level) are found first, by a summary of bounded size
   for each task; their least occurrences are aggregated and broadcast (a bounded number), and their occurrences are
   matched where they are; an occurrence whose key is frequent at one level meets the others at the next.  Which keys
   count as frequent changes where work is done, never a result.
4. Matches go to the later document.  Runs on one diagonal become segments; segments of a pair of documents
   are chained in order, for the greatest sum of lengths less gap costs, with a Fenwick tree of maxima over
   source positions.  A chain is aligned: the words between its segments count as substituted, inserted or deleted.
5. Spans of a document that touch are joined, whatever their sources; spans of min_words or more remain.

Null, empty and short texts have no passages; rows without doc_id are ignored; rows of one doc_id with differing texts
are versions of a document, told apart by a hash of the text and never compared with one another; equal rows count
once.  Very long texts are read whole, a million bytes or one text at a time.  Of equal chains the first in the order of
start counts, of spans joined the longest names the source, of equals that of least doc_id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.llm import hashing as H
from basaltql.llm.common import BROADCAST_ROWS, Scratch, arrow_pass, release, unused

#: Words of context at the levels of matching.
WINDOW, SIDE, WIDE = 6, 5, 40
GAP_COST, LEAST_CHAIN, LEAST_COVER, LONG_GAP = 0.125, 18, 0.4, 40
#: A key is frequent with more than one part in 2 * HOT_KEYS of all occurrences (and more than HOT_ROWS); a task's summary holds SUMMARY keys.
HOT_KEYS, HOT_ROWS, SUMMARY = 4096, 256, 1 << 16
#: Rows are sent on so many at a time.
ROWS = 200_000


def minimizers(s: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Indices of the values that are least in some WINDOW successive values of their text."""
    n = len(s) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    valid = text[:n] == text[WINDOW - 1 :]
    least = s[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, s[k : n + k], out=least)
    chosen = np.zeros(len(s), bool)
    for k in range(WINDOW):
        chosen[k : n + k] |= (s[k : n + k] == least) & valid
    return np.flatnonzero(chosen)


#: A side is one 64-bit value: SIDE words, nearest first, with BITS bits of each one's hash (0 beyond the text), and above them
#: the rest of the bits for a hash of the WIDE words next to the seed (0 where there are fewer).
BITS = 9
_FAR = np.uint64(BITS * SIDE)
_NEAR_MASK = np.uint64((1 << BITS * SIDE) - 1)


def _sides(h: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sides before and after the seed at word w."""
    code = h % np.uint64((1 << BITS) - 1) + np.uint64(1)
    left, right, nothing = np.zeros(len(w), np.uint64), np.zeros(len(w), np.uint64), np.uint64(0)
    for k in range(SIDE):
        at = w - 1 - k
        left |= np.where(at >= low, code[np.maximum(at, 0)], nothing) << np.uint64(BITS * k)
        at = w + width + k
        right |= np.where(at < high, code[np.minimum(at, len(h) - 1)], nothing) << np.uint64(BITS * k)
    power, inverse = H._power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])

    def wide(begin: np.ndarray, fits: np.ndarray) -> np.ndarray:
        at = np.where(fits, begin, 0)
        end = np.minimum(at + WIDE, len(h))
        return np.where(fits, np.maximum(H.mix((total[end] - total[at]) * inverse[at]) >> _FAR, np.uint64(1)), nothing) << _FAR

    return left | wide(w - WIDE, w - WIDE >= low), right | wide(w + width, w + width + WIDE <= high)


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words next to a seed are the same."""
    n, on = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(SIDE):
        word = (x >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)
        on &= (word > 0) & (word == (y >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1))
        n += on
    return n


Rows = tuple[np.ndarray, ...]
#: Levels of matching: the seed alone, with SIDE words after or before it, with WIDE more words after or before these.
SEED, AFTER, BEFORE, FAR_AFTER, FAR_BEFORE, MATCHED = range(6)
#: The levels that a row of a kind (the level of its key) is matched at.
_LEVELS = {SEED: (SEED, AFTER, BEFORE, FAR_AFTER, FAR_BEFORE), AFTER: (AFTER, FAR_AFTER), BEFORE: (BEFORE, FAR_BEFORE), FAR_AFTER: (FAR_AFTER,), FAR_BEFORE: (FAR_BEFORE,)}


def _key(level: int, key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The key of an occurrence at a level from its key one level before and the part of the side that the level adds."""
    part = side >> _FAR if level in (FAR_AFTER, FAR_BEFORE) else side & _NEAR_MASK
    return H.mix(key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + part * np.uint64(8) + np.uint64(level)).view(np.int64)


def _keys(o: Rows) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, whether there is one) of occurrences at each level."""
    seed, _, _, _, left, right = o
    every = np.ones(len(seed), bool)
    after, before = _key(AFTER, seed, right), _key(BEFORE, seed, left)
    return [(seed, every), (after, every), (before, every), (_key(FAR_AFTER, after, right), right >> _FAR > 0), (_key(FAR_BEFORE, before, left), left >> _FAR > 0)]


def _segments(o: Rows, later: np.ndarray, level: int, width: int, src: np.ndarray, s_pos: np.ndarray, s_left: np.ndarray, s_right: np.ndarray) -> Rows:
    """doc, version, start, end, src, s_start of matches at a level: the seed with the equal words next to it."""
    pos, before, after = o[3][later], _equal(o[4][later], s_left), _equal(o[5][later], s_right)
    if level == FAR_AFTER:
        after = np.full(len(later), WIDE)
    elif level == FAR_BEFORE:
        before = np.full(len(later), WIDE)
    return o[1][later], o[2][later], pos - before, pos + width + after, src, s_pos - before


def _joined(found: Rows) -> Rows:
    """Matches (doc, start, end, src, s_start) that overlap or touch on a diagonal of two documents as one."""
    doc, start, end, src, at = found
    order = np.lexsort((start, start - at, src, doc))
    doc, start, end, src, at = (x[order] for x in found)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (start[1:] - at[1:] != start[:-1] - at[:-1])
    # The furthest end so far within a diagonal, by lifting each diagonal above all before it.
    lift = (np.cumsum(new) - 1) * (int(end.max(initial=0)) + 1)
    far = np.maximum.accumulate(end + lift) - lift
    new[1:] |= start[1:] > far[:-1]
    a = np.flatnonzero(new)
    return doc[a], start[a], far[np.append(a[1:], len(doc)) - 1], src[a], at[a]


def occurrences(ids: np.ndarray, versions: np.ndarray, part: list[bytes], width: int) -> Rows:
    """seed, doc, version, pos, left, right of all occurrences of seeds in a group of texts."""
    h, first, *_ = H.words(part)
    s, text, word = H.shingles(h, first, width)
    i = minimizers(s, text)
    text = text[i]
    low = first[text]
    return s[i].view(np.int64), ids[text], versions[text], word[i].astype(np.int64), *_sides(h, low, first[text + 1], low + word[i], width)


def _groups_of(b: pa.RecordBatch, width: int) -> Iterator[Rows]:
    ids, versions = b.column(0).to_numpy(), b.column(2).to_numpy()
    for at, part in H.groups(t.as_py() for t in b.column(1)):
        o = occurrences(ids[at : at + len(part)], versions[at : at + len(part)], part, width)
        if len(o[0]):
            yield o


def version() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.shiftright(F.xxhash64(F.col("text").cast("string")), 32).cast("int")


def _texts(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    return docs.where(F.col("doc_id").isNotNull()), [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), version().alias("version")]


def _batch(columns: list[np.ndarray], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS], t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _spelled(schema: list[tuple[str, pa.DataType]]) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.int8(): "byte"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in schema)


_LONG, _INT = pa.int64(), pa.int32()
_FOUND = [("doc", _LONG), ("version", _INT), ("start", _INT), ("end", _INT), ("src", _LONG), ("s_start", _INT)]
#: place is the version, the kind of key and the position (32, 4 and 28 bits); of a match (kind MATCHED), left is the source, right the start there and the length.
_SEEDS = [("key", _LONG), ("doc", _LONG), ("place", _LONG), ("left", _LONG), ("right", _LONG)]
_LEAST = [("key", _LONG), ("doc", _LONG), ("pos", _LONG), ("left", _LONG), ("right", _LONG)]


def _seed_rows(key: np.ndarray, doc: np.ndarray, version: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    yield from _batch([key, doc, version.astype(np.int64) << 32 | kind << 28 | pos, left.view(np.int64), right.view(np.int64)], _SEEDS)


def _from_rows(columns: list[np.ndarray]) -> tuple[Rows, np.ndarray]:
    """(occurrences, kinds) of rows of the seeds' schema."""
    key, doc, place, left, right = columns
    return (key, doc, place >> 32, place & ((1 << 28) - 1), left.view(np.uint64), right.view(np.uint64)), place >> 28 & 15


def frequent_keys(docs: DataFrame, width: int) -> np.ndarray:
    """Keys of any level that very many occurrences have, sorted: at most 10 * HOT_KEYS.

    A task keeps the SUMMARY most frequent keys so far; what falls off is counted off from all (Misra and Gries, 1982).
    """
    rows, columns = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size, total = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            every, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n]), len(every)).astype(np.int64)
            if len(every) > SUMMARY:
                off = int(np.partition(n, len(n) - SUMMARY - 1)[len(n) - SUMMARY - 1])
                every, n = every[n > off], n[n > off] - off
            return every, n

        for b in batches:
            for o in _groups_of(b, width):
                total += len(o[0])
                for key, there in _keys(o):
                    waiting.append(key[there])
                    size += len(waiting[-1])
                if size > 1_000_000:
                    keys, counts = summed()
                    waiting, size = [], 0
        keys, counts = summed()
        some = counts > max(1, total // (16 * HOT_KEYS))
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[some].tolist()], _LONG), pa.array([total, *counts[some].tolist()], _LONG)], ["key", "n"])
        release()

    found = Scratch(docs.sparkSession).keep(rows.select(*columns).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = found.where("key is null").agg(F.max("n")).first()[0] or 0
    chosen = found.where(F.col("key").isNotNull() & (F.col("n") > max(HOT_ROWS, total // (2 * HOT_KEYS)))).select("key").collect()
    return np.sort(np.array([r.key for r in chosen], np.int64))


def least_occurrences(docs: DataFrame, hot: np.ndarray, width: int) -> Rows:
    """key, doc, pos, left, right of the least occurrence of each frequent key, in the order of keys."""
    if not len(hot):
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2))
    rows, columns = _texts(docs)
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for o in _groups_of(b, width):
            for key, there in _keys(o):
                i = np.flatnonzero(there & _known(known.value, key))
                found.append((key[i], *(o[k][i] for k in (1, 3, 4, 5))))
        if found:
            key, doc, pos, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, doc, key))
            first = order[np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))]
            yield from _batch([key[first], doc[first], pos[first], left[first].view(np.int64), right[first].view(np.int64)], _LEAST)

    least = arrow_pass(rows, columns, _spelled(_LEAST), batch).groupBy("key").agg(F.min(F.struct("doc", "pos", "left", "right")).alias("o"))
    key, doc, pos, left, right = (c.to_numpy() for c in least.select("key", "o.doc", "o.pos", "o.left", "o.right").orderBy("key").toArrow().columns)
    return key, doc, pos, left.view(np.uint64), right.view(np.uint64)


def _known(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def seeds(docs: DataFrame, width: int) -> DataFrame:
    """Occurrences to be matched by key, and matches of frequent keys."""
    rows, columns = _texts(docs)
    least = docs.sparkSession.sparkContext.broadcast(least_occurrences(docs, frequent_keys(docs, width), width))

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hot, l_doc, l_pos, l_left, l_right = least.value
        for o in _groups_of(b, width):
            keys = _keys(o)
            is_hot = [_known(hot, k) for k, _ in keys]
            sent = [(SEED, ~is_hot[SEED])]
            for near, far in ((AFTER, FAR_AFTER), (BEFORE, FAR_BEFORE)):
                sent += [(near, is_hot[SEED] & ~is_hot[near]), (far, is_hot[SEED] & is_hot[near] & keys[far][1] & ~is_hot[far])]
            for kind, chosen in sent:
                i = np.flatnonzero(chosen)
                yield from _seed_rows(keys[kind][0][i], *(x[i] for x in o[1:]), kind)
            found = []
            for level, (key, there) in enumerate(keys):
                above = {SEED: [], AFTER: [SEED], BEFORE: [SEED], FAR_AFTER: [SEED, AFTER], FAR_BEFORE: [SEED, BEFORE]}[level]
                i = np.flatnonzero(there & is_hot[level] & np.logical_and.reduce([np.ones(len(key), bool), *(is_hot[x] for x in above)]))
                k = np.searchsorted(hot, key[i])
                earlier = l_doc[k] < o[1][i]
                i, k = i[earlier], k[earlier]
                found.append(_segments(o, i, level, width, l_doc[k], l_pos[k], l_left[k], l_right[k]))
            yield from _match_rows(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return arrow_pass(rows, columns, _spelled(_SEEDS), batch)


def _match_rows(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray, src: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matches as rows of the seeds' schema, joined on diagonals; keys spread them."""
    if not len(doc):
        return
    # A document's versions are told apart while they are joined.
    both, back = np.unique(np.stack([doc, version]), axis=1, return_inverse=True)
    d, a, z, s, t = _joined((back.reshape(-1), start, end, src, at))
    doc, version = both[0][d], both[1][d]
    yield from _seed_rows(H.mix(doc.view(np.uint64) + a.astype(np.uint64)).view(np.int64), doc, version, a, s, t << 32 | (z - a), MATCHED)


def match_runs(o: Rows, kind: np.ndarray, width: int) -> Iterator[Rows]:
    """doc, version, start, end, src, s_start for whole runs of keys, in the order of (key, doc, version, pos): each level's matches."""
    key, doc = o[0], o[1]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], len(key)) - 1
    shared = np.repeat(doc[first] != doc[last], last - first + 1)
    # Rows that repeat a document and its text count once.
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (o[2][1:] == o[2][:-1]) & (o[3][1:] == o[3][:-1])])
    chosen = np.flatnonzero(shared & ~again)
    o, kind = tuple(x[chosen] for x in o), kind[chosen]
    if not len(kind):
        return
    known: list[np.ndarray] = []  # pairs that a wider level has found
    codes: dict[int, np.ndarray] = {SEED: o[0]}
    for level, above, side in ((AFTER, SEED, o[5]), (BEFORE, SEED, o[4]), (FAR_AFTER, AFTER, o[5]), (FAR_BEFORE, BEFORE, o[4])):
        codes[level] = np.where(kind == level, o[0], _key(level, codes[above], side))
    for level in (FAR_AFTER, FAR_BEFORE, AFTER, BEFORE, SEED):
        on = np.isin(kind, [k for k, levels in _LEVELS.items() if level in levels])
        if level in (FAR_AFTER, FAR_BEFORE):
            on &= (o[5] if level == FAR_AFTER else o[4]) >> _FAR > 0
        i = np.flatnonzero(on)
        _, leader, back = np.unique(codes[level][i], return_index=True, return_inverse=True)
        partner = i[leader[back]]
        earlier = o[1][partner] < o[1][i]
        i, partner = i[earlier], partner[earlier]
        pair = i * len(kind) + partner
        if level not in (FAR_AFTER, FAR_BEFORE) and known:
            new = ~np.isin(pair, np.concatenate(known))
            i, partner, pair = i[new], partner[new], pair[new]
        known.append(pair)
        yield _segments(o, i, level, width, o[1][partner], o[3][partner], o[4][partner], o[5][partner])


def matches(docs: DataFrame, width: int) -> DataFrame:
    """(doc, version, start, end, src, s_start): words of a document about a seed that stand in an earlier document too."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def done(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for found in match_runs(*_from_rows(arrays), width):
                yield from _batch(list(found), _FOUND)

        for b in batches:
            arrays = [c.to_numpy() for c in b.columns]
            matched = (arrays[2] >> 28 & 15) == MATCHED
            if matched.any():
                (_, doc, text, start, *_), _ = _from_rows(arrays)
                src, more = arrays[3][matched], arrays[4][matched]
                yield from _batch([doc[matched], text[matched], start[matched], start[matched] + (more & 0xFFFFFFFF), src, more >> 32], _FOUND)
                arrays = [x[~matched] for x in arrays]
            if not len(arrays[0]):
                continue
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(arrays[0], arrays[0][-1]))
            if cut:
                yield from done([np.concatenate([k[i] for k in kept] + [x[:cut]]) for i, x in enumerate(arrays)])
                kept = []
            elif kept and kept[-1][0][-1] != arrays[0][0]:
                yield from done([np.concatenate([k[i] for k in kept]) for i in range(len(arrays))])
                kept = []
            kept.append([x[cut:] for x in arrays])
        if kept:
            yield from done([np.concatenate([k[i] for k in kept]) for i in range(len(_SEEDS))])
        release()

    return seeds(docs, width).repartition("key").sortWithinPartitions("key", "doc", "place").mapInArrow(link, _spelled(_FOUND))


def chain(start: np.ndarray, end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray) -> list[list[int]]:
    """Disjoint chains of segments (in order of start) that go forward in both texts, best first.

    score(j) = length(j) + max(0, score(i) - GAP_COST * (gap in the text + gap in the source)) over the segments i
    that end before j in both; a Fenwick tree over source ends holds the maxima.
    """
    n = len(start)
    if n == 1:
        return [[0]]
    ends = sorted(set(s_end.tolist()))
    rank = {e: i + 1 for i, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ends) + 1)
    by_end = np.argsort(end, kind="stable").tolist()
    score, back, put = [0.0] * n, [-1] * n, 0
    for j in np.argsort(start, kind="stable").tolist():
        while put < n and end[by_end[put]] <= start[j]:
            i = by_end[put]
            put += 1
            value = (score[i] + GAP_COST * float(end[i] + s_end[i]), i)
            r = rank[int(s_end[i])]
            while r < len(tree):
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        r, best = int(np.searchsorted(ends, s_start[j], side="right")), (0.0, -1)
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - GAP_COST * float(start[j] + s_start[j]) if best[1] >= 0 else 0.0
        score[j] = float(end[j] - start[j]) + max(0.0, gain)
        back[j] = best[1] if gain > 0 else -1
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def pieces(paths: list[list[int]], start: np.ndarray, end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray) -> Iterator[list[int]]:
    """Chains parted where more than LONG_GAP words of either text lie between two segments: those are passages of their own."""
    for path in paths:
        cut = 0
        for k in range(1, len(path)):
            i, j = path[k - 1], path[k]
            if max(start[j] - end[i], s_start[j] - s_end[i]) > LONG_GAP:
                yield path[cut:k]
                cut = k
        yield path[cut:]


def align(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], min_words: int) -> list[tuple[int, int, int, int, float]]:
    """From a document's matches (source, start, end, start there): (start, end, source, source start, share of equal words) of its passages.

    Between two segments of a chain an alignment has as many edits as the longer of the two gaps has words: what is
    equal next to a segment belongs to it.
    """
    _, start, end, source, s_start = _joined((np.zeros(len(found[0]), np.int64), found[1], found[2], found[0], found[3]))
    s_end = s_start + end - start
    cuts = np.concatenate([[0], np.flatnonzero(source[1:] != source[:-1]) + 1, [len(source)]])
    spans = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        # A word less, as a word that is inserted beside its like belongs to two segments.
        for path in pieces(chain(start[x:y] + 1, end[x:y], s_start[x:y] + 1, s_end[x:y]), start[x:y], end[x:y], s_start[x:y], s_end[x:y]):
            low, high = int(start[x + path[0]]), int(end[x + path[-1]])
            equal, edits, reach, s_reach = 0, 0, low, int(s_start[x + path[0]])
            for i in path:
                a, z = int(start[x + i]), int(end[x + i])
                edits += max(0, a - reach, int(s_start[x + i]) - s_reach)
                equal += max(0, z - max(reach, a))
                reach, s_reach = z, int(s_end[x + i])
            if high - low >= LEAST_CHAIN and equal >= LEAST_COVER * (equal + edits):
                spans.append((low, high, int(source[x]), int(s_start[x + path[0]]), equal / (equal + edits)))
    spans.sort()
    out = []
    while spans:
        group, high = [spans[0]], spans[0][1]
        for s in spans[1:]:
            if s[0] > high + WINDOW:
                break
            group.append(s)
            high = max(high, s[1])
        spans = spans[len(group) :]
        low = group[0][0]
        if high - low >= min_words:
            best = max(group, key=lambda s: (s[1] - s[0], -s[2]))
            out.append((low, high, best[2], best[3], best[4]))
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, width: int = 5, min_words: int = 50) -> DataFrame:
    """doc_id, version, start_word, end_word, n_words, source_id, source_start, covered: the passages that an earlier document has too.

    version is that of version(): it differs between rows of one doc_id with differing texts.
    """

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(arrays: list[np.ndarray]) -> list[tuple]:
            doc, text = arrays[:2]
            cuts = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1, [len(doc)]])
            return [(int(doc[x]), int(text[x]), *r) for x, y in zip(cuts[:-1], cuts[1:], strict=True) for r in align((arrays[4][x:y], arrays[2][x:y], arrays[3][x:y], arrays[5][x:y]), min_words)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, text, low, high, src, at, covered = zip(*rows, strict=True)
            long = lambda x: pa.array(x, _LONG)
            return pa.RecordBatch.from_arrays([long(doc), pa.array(text, _INT), long(low), long(high), long([b - a for a, b in zip(low, high, strict=True)]), long(src), long(at), pa.array(covered, pa.float64())], ["doc_id", "version", "start_word", "end_word", "n_words", "source_id", "source_start", "covered"])

        for b in batches:
            if not b.num_rows:
                continue
            arrays = [c.to_numpy().astype(np.int64) for c in b.columns]
            if rest is not None:
                arrays = [np.concatenate([r, x]) for r, x in zip(rest, arrays, strict=True)]
            # The last document of a batch may go on in the next one.
            cut = int(np.flatnonzero((arrays[0] != arrays[0][-1]) | (arrays[1] != arrays[1][-1]))[-1:].sum() + 1) if arrays[0][0] != arrays[0][-1] or arrays[1][0] != arrays[1][-1] else 0
            rest = [x[cut:] for x in arrays]
            if cut and (rows := done([x[:cut] for x in arrays])):
                yield out(rows)
        if rest is not None and (rows := done(rest)):
            yield out(rows)
        release()

    found = matches(docs, width).repartition("doc", "version").sortWithinPartitions("doc", "version", "src", "start", "s_start", "end")
    return found.mapInArrow(per_document, "doc_id long, version int, start_word long, end_word long, n_words long, source_id long, source_start long, covered double")


def remove_repeated(spark: SparkSession, docs: DataFrame, width: int = 5, min_words: int = 50) -> DataFrame:
    """docs with repeated passages cut from their texts (their first document keeps them); a text of which nothing is left goes.

    Rows of one doc_id with differing texts lose their own passages only; rows without doc_id stay as they are.
    """
    names = docs.columns
    key, text, spots = unused(docs, "key"), unused(docs, "version"), unused(docs, "spots")
    spans = Scratch(spark).keep(repeated_passages(spark, docs, width, min_words).select("doc_id", "version", "start_word", "end_word"))
    cuts = spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spots")).toDF(key, text, spots)
    if spans.count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)  # else the texts are shuffled
    joined = docs.join(cuts, (docs["doc_id"].cast("long") == F.col(key)) & (F.shiftright(F.xxhash64(docs["text"].cast("string")), 32).cast("int") == F.col(text)), "left")
    place, count = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, every = b.column(place).to_pylist(), b.column(len(names)).to_pylist()
        sizes = b.column(count).to_pylist() if count >= 0 else []
        keep = []
        for i, spots in enumerate(every):
            keep.append(True)
            if not spots:
                continue
            raw = texts[i].encode("utf-8", "surrogatepass")
            _, _, starts, ends, _ = H.words([raw.lower()])
            parts, at = [], 0
            for s in spots:
                parts.append(raw[at : starts[s["start_word"]]])
                at = int(ends[s["end_word"] - 1])
            texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
            keep[-1] = bool(texts[i].strip())
            if count >= 0:
                sizes[i] = len(texts[i])
        columns = list(b.columns[: len(names)])
        columns[place] = pa.array(texts, columns[place].type)
        if count >= 0:
            columns[count] = pa.array(sizes, columns[count].type)
        yield pa.RecordBatch.from_arrays(columns, b.schema.names[: len(names)]).filter(pa.array(keep))

    return arrow_pass(joined, [*(docs[c] for c in names), F.col(spots)], docs.schema, batch)
