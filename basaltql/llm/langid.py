"""Language ID (operator 9): rank-order profiles (Cavnar and Trenkle, 1994).

The profile of a language, or of a text, ranks its PROFILE most frequent letter sequences of one to three
characters, word ends included.  A text's distance to a language is the sum over its sequences of the
differences of ranks, sequences that the language's profile lacks counting PROFILE; the nearest language wins,
the first by name among equals.  Counts of a language are summed by batch, then by sequence; a task sends on only
its PROFILE most frequent sequences of a language to be ranked.

Null texts and texts without a letter give und and score 0, and so do all if no language was learned.  Rows
with null language are not learned from.  Very long texts are read whole.  Every row is predicted, repeated ones each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltql.llm.common import arrow_pass, held_out, id_and_text

PROFILE = 300
_letter: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """The codes of all sequences of one to three characters: 21 bits each, 0 between words."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.zeros(len(raw) + 2, np.int64)
    c[1:-1] = np.where(_letter[0][raw], raw, 0)
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
    two, three = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate([c[c > 0], two[(c[:-1] > 0) | (c[1:] > 0)] | 1 << 62, three[c[1:-1] > 0]]) if len(c) > 2 else c[c > 0]


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes, best first; equals in the order of their codes."""
    return codes[np.lexsort((codes, -counts))[:PROFILE]]


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The profile of each language, from all training rows; sums are made by batch before the shuffle."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add(lang: str) -> None:
            codes, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], codes])
                weights = np.concatenate([sums[lang][1], counts])
                codes, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, weights).astype(np.int64)
            sums[lang] = codes, counts

        for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(grams(t.as_py() or ""))
            if sum(map(len, waiting[lang])) > 2_000_000:
                add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    summed = arrow_pass(rows, [F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")], "lang string, code long, n long", batch, whole=True).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= PROFILE)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "rank", "code").collect():  # PROFILE rows a language
        out.setdefault(r.lang, []).append((r.rank, r.code))
    return {lang: np.array([c for _, c in sorted(v)], np.int64) for lang, v in sorted(out.items())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        self.codes, self.ranks = [], []
        for p in profiles.values():
            order = np.argsort(p)
            self.codes.append(p[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one less the distance as a share of the greatest possible."""
        found = grams(text or "")
        if not len(found) or not self.names:
            return "und", 0.0
        mine = ranked(*np.unique(found, return_counts=True))
        place = np.arange(len(mine))
        far = []
        for codes, ranks in zip(self.codes, self.ranks, strict=True):
            i = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            far.append(int(np.where(codes[i] == mine, np.abs(ranks[i] - place), PROFILE).sum()))
        best = int(np.argmin(far))
        return self.names[best], 1.0 - far[best] / (PROFILE * len(mine))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = shared.value
        found = [p.predict(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_pass(docs, id_and_text((held_out().alias("held_out"),)), "doc_id long, held_out boolean, lang_pred string, score double", batch)
