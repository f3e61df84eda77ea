"""Quality classifier (operator 8): nearest-neighbour voting in a latent space.

Features of a text are the shares of byte-class trigrams (letters by case, digits, kinds of punctuation and of
space) and of repeated words and lines, weighted by inverse document frequency.  The leading singular vectors
of a bounded labelled sample span the latent space; its labelled vectors are broadcast, every document is
compared with all of them by blocked products of unit vectors, and its NEIGHBOURS nearest vote with weights
that grow with the cosine.  Cosines count to six digits; all that equal the last neighbour's vote too, so that no
order of the sample matters.

Null and empty texts have no features: their score is the share of good texts in the sample.  Without labelled
training rows every score is 0.5.  Ids whose labels disagree teach nothing; of rows with one doc_id the text of least
hash does.  Very long texts are read whole.  Every row is scored, repeated ones each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm import hashing as H
from basaltql.llm.common import arrow_pass, held_out, id_and_text, labelled, texts_of

#: The bound of the labelled sample, for each label; dimensions; voters.
ROWS_PER_LABEL, DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 1500, 48, 15, 12.0, 0.5

_CLASS = np.full(256, 11, np.int64)  # other punctuation
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x80:] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[[ord(c) for c in ".?;:"]] = 6
_CLASS[ord(",")] = 7
_CLASS[ord("!")] = 8
_CLASS[[ord(c) for c in "|\\/_<>{}[]"]] = 9
_CLASS[[ord(c) for c in "#$%&*@^~+="]] = 10
KINDS = 12
_REPEATS = 6
FEATURES = KINDS**3 + _REPEATS


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text, in float32."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for at, part in H.groups(texts):
        h, first, starts, _, buffer = H.words(part)
        a = np.frombuffer(buffer, np.uint8)
        line = np.cumsum(a == 10)
        for i, low in enumerate(part):
            if not low:
                continue
            raw = _CLASS[np.frombuffer(texts[at + i].encode("utf-8", "surrogatepass"), np.uint8)]
            if len(raw) >= 3:
                out[at + i, : KINDS**3] = np.bincount(raw[:-2] * KINDS**2 + raw[1:-1] * KINDS + raw[2:], minlength=KINDS**3) / (len(raw) - 2)
            w = h[first[i] : first[i + 1]]
            if len(w) > 1:
                n = len(w) - 1
                rows = line[starts[first[i] : first[i + 1]]]
                begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                lines = np.add.reduceat(w, begin)
                _, back, count = np.unique(lines, return_inverse=True, return_counts=True)
                size = np.diff(np.append(begin, len(w)))
                near = w[1:] == w[:-1]
                for k in range(2, 9):
                    near[k - 1 :] |= w[k:] == w[:-k]
                out[at + i, KINDS**3 :] = [(w[1:] == w[:-1]).sum() / n, near.sum() / n, size[count[back] > 1].sum() / len(w), len(np.unique(w)) / len(w) / 4, min(1, np.log1p(len(w)) / 40), 1 / len(w)]
    np.sqrt(out, out=out)
    return out


@dataclass
class Model:
    weight: np.ndarray
    axes: np.ndarray
    known: np.ndarray
    label: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.weight) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.label):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            x = features(texts[i : i + 256])
            cosine = np.round(self.latent(x) @ self.known.T, 6)
            k = min(NEIGHBOURS, cosine.shape[1])
            last = np.partition(cosine, -k, axis=1)[:, -k]
            row, near = np.nonzero(cosine >= last[:, None])
            vote = np.exp(SHARPNESS * (cosine[row, near].astype(np.float64) - 1))
            share = np.bincount(row, vote * self.label[near], len(x)) / np.bincount(row, vote, len(x))
            out[i : i + 256] = np.where(x.any(axis=1), share, self.label.mean())
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of at most ROWS_PER_LABEL training rows of each label, the least by hash of their id."""
    known, sample = labelled(labels, "quality"), None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(ROWS_PER_LABEL)
        sample = some if sample is None else sample.unionAll(some)
    texts = texts_of(docs, sample)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = features(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    rows = arrow_pass(texts, [F.col("text"), F.col("id"), F.col("label")], "id long, label int, x binary", batch).toArrow()
    if len(set(rows.column("label").to_pylist())) < 2:
        return Model(*(np.zeros(0, np.float32) for _ in range(4)))
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("id").to_numpy()))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)[order]
    label = rows.column("label").to_numpy()[order].astype(np.float64)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
    y = x * weight
    _, axes = np.linalg.eigh(y.T @ y)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    model = Model(weight, axes, np.zeros(0), label)
    model.known = model.latent(x)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = shared.value.scores(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_pass(docs, id_and_text((held_out().alias("held_out"),)), "doc_id long, held_out boolean, score double, predicted int", batch)
