"""Document fingerprints (operator 2): a Merkle tree over sections, paragraphs and sentences.

A document is cut at blank lines into sections (and, where there are none, after paragraphs whose digest
ends in three zero bits, so that cuts move with the text), a section into paragraphs at line ends, a
paragraph into sentences.  A node's digest covers its children's, so roots are equal exactly for equal texts
and only differing branches need be compared: compare() goes down from the root, pairs nodes that both trees hold
(those at either end first, then the first of equals with the first) and gives the character ranges of the leaves
below those that differ.

Null texts count as empty; two empty texts have likeness 1.  Documents with one doc_id follow each other in
the order of their texts.  Very long texts are hashed whole, one at a time.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltql.llm.common import Scratch, id_and_text, release

_SENTENCE = re.compile(r"[^.!?;|]{1,48}[.!?;|]*|[.!?;|]+", re.S)
Node = tuple[bytes, int, list]


def _digest(parts: list[bytes], level: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()


def tree(text: str) -> Node:
    """(digest, characters, children) of the document; its children are sections, theirs paragraphs, theirs sentences."""
    sections: list[Node] = []
    paragraphs: list[Node] = []

    def close() -> None:
        if paragraphs:
            sections.append((_digest([p[0] for p in paragraphs], b"section"), sum(p[1] for p in paragraphs), paragraphs.copy()))
            paragraphs.clear()

    for line in text.splitlines(keepends=True):
        leaves = [(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(s), []) for s in _SENTENCE.findall(line)]
        paragraphs.append((d := _digest([x[0] for x in leaves], b"paragraph"), len(line), leaves))
        if not d[0] & 7 or not line.strip():
            close()
    close()
    return _digest([s[0] for s in sections], b"document"), len(text), sections


Placed = tuple[int, Node]


def _level(side: list[Placed]) -> list[Placed]:
    """The children of nodes, each with its first character."""
    out = []
    for at, node in side:
        for child in node[2]:
            out.append((at, child))
            at += child[1]
    return out


def _ranges(side: list[Placed]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, node in side:
        if out and out[-1][1] == at:
            out[-1] = out[-1][0], at + node[1]
        elif node[1]:
            out.append((at, at + node[1]))
    return out


def compare(a: Node, b: Node) -> tuple[float, list[tuple[int, int]], list[tuple[int, int]]]:
    """(likeness, ranges of a, ranges of b): the characters of each text below branches that the other tree does not hold.

    The likeness is twice the characters below common nodes over all characters: 1 for equal trees, 0 for trees
    without a common node.  Only branches that differ are gone into.
    """
    if a[0] == b[0]:
        return 1.0, [], []
    left, right, common = [(0, a)], [(0, b)], 0
    for _ in range(3):
        left, right = _level(left), _level(right)
        # What begins and ends alike is paired in order, so that the rest lies where the edit was.
        fewest, head, tail = min(len(left), len(right)), 0, 0
        while head < fewest and left[head][1][0] == right[head][1][0]:
            head += 1
        while tail < fewest - head and left[-1 - tail][1][0] == right[-1 - tail][1][0]:
            tail += 1
        common += 2 * sum(x[1] for _, x in [*left[:head], *left[len(left) - tail :]])
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        both = Counter(x[0] for _, x in left) & Counter(x[0] for _, x in right)
        sides = []
        for side in (left, right):
            open_, rest = both.copy(), []
            for at, x in side:
                if open_[x[0]] > 0:
                    open_[x[0]] -= 1
                    common += x[1]
                else:
                    rest.append((at, x))
            sides.append(rest)
        left, right = sides
    return common / max(1, a[1] + b[1]), _ranges(left), _ranges(right)


def likeness(a: Node, b: Node) -> float:
    return compare(a, b)[0]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the document that follows."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.list_(pa.list_(pa.int64())))]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<array<bigint>>"
_EDGES = [("at", pa.int32()), ("edge", pa.string()), ("text", pa.string())]


def _compared(doc_id: int | None, text: str, t: Node, following: str, n: Node) -> tuple:
    changed = edited(text, following)
    e = tree(changed)
    near, places, _ = compare(t, e)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), t[0].hex(), e[0].hex(), near, likeness(t, n), [list(x) for x in places]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text: an Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() or "" for t in b.column(1))
            rows = [(i, len(t), tree(t)[0].hex()) for i, t in zip(b.column(0).to_pylist(), texts, strict=True)]
            yield _batch(rows, [_FIELDS[0], _FIELDS[1], _FIELDS[3]])

    return docs.select(*id_and_text()).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compare_with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness to each other and to the next document's, and edits:
    the character ranges [from, to) of the text below branches that the edited text's tree does not hold.

    One range shuffle puts documents in order.  A partition finishes all its documents but the last, whose
    neighbour opens the next partition that is not empty: first and last texts, two for each partition, meet in a
    join by partition.  Only the numbers of the partitions, never texts, are ordered in one task.
    """

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, last, done = TaskContext.get().partitionId(), None, []
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = x.as_py() or ""
                t = tree(text)
                if last is None:
                    done.append((i, *[None] * 7, at, "first", text))
                else:
                    done.append((*_compared(*last, text, t), None, None, None))
                last = i, text, t
                if len(done) >= 512:
                    yield _batch(done, _FIELDS + _EDGES)
                    done = []
        if last is not None:
            yield _batch([*done, (last[0], *[None] * 7, at, "last", last[1])], _FIELDS + _EDGES)
        release()

    scratch = Scratch(spark)
    ordered = docs.select(*id_and_text()).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = scratch.keep(ordered.mapInArrow(in_order, f"{_SCHEMA}, at int, edge string, text string"))

    first = found.where("edge = 'first'").select(F.col("at").alias("next_at"), F.col("text").alias("following"))
    used = found.where("edge = 'last'").select("at")  # a number for each partition
    whole = Window.partitionBy()
    after = used.select("at", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(whole)).alias("next_at"))
    paired = found.where("edge = 'last'").select("doc_id", "text", "at").join(after, "at").join(first, "next_at")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, following in zip(*b.columns, strict=True):
                text, following = text.as_py(), following.as_py()
                yield _batch([_compared(i.as_py(), text, tree(text), following, tree(following))], _FIELDS)

    finished = paired.select("doc_id", "text", "following").mapInArrow(finish, _SCHEMA)
    return found.where("edge is null").select(*(name for name, _ in _FIELDS)).unionByName(finished)
