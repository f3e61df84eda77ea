"""License scans (operator 6): an exact set-similarity join of text blocks with license templates.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; a block is a line, or a window
of a quarter more words than the template has, wherever its lines end, so that wrapped notices are found.  Template
words are ordered by their frequency in all of the documents.  A block that contains enough of a template
must hold one of its rarest words (prefix filter), enough distinct words (length filter), and enough of the
words that follow the first common one in this order (positional filter); what passes is counted exactly.

Besides, phrases give labels where their words stand consecutively.  Null and empty texts have no words and
no labels.  Words of equal frequency go by their letters.  Very long texts are scanned whole.  Every row is scanned,
repeated ones each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm import hashing as H
from basaltql.llm.common import arrow_pass, id_and_text

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The words of public license notices, clause by clause; templates is a parameter for more.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
}
PERCENT = 90
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts each of the template's words stands; summed by batch before the shuffle."""
    known = H.words([w.encode() for w in words], H.NOT_ALNUM)[0]
    order = np.argsort(known)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(words), np.int64)
        for _, part in H.groups(t.as_py() for t in b.column(0)):
            h, first, *_ = H.words(part, H.NOT_ALNUM)
            i = np.minimum(np.searchsorted(known[order], h), len(words) - 1)
            hit = np.flatnonzero(known[order][i] == h)
            text = np.searchsorted(first, hit, side="right") - 1
            pairs = np.unique(text * len(words) + order[i[hit]])
            count += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(count)], ["word", "n"])

    return {r.word: r.n for r in arrow_pass(docs, [F.col("text").cast("string").alias("text")], "word string, n long", batch, whole=True).groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Join:
    """Templates with their words in the order of global frequency, rarest first."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], percent: int):
        rank = {w: i for i, w in enumerate(sorted({w for ts in templates.values() for t in ts for w in t.split()}, key=lambda w: (frequency.get(w, 0), w)))}
        self.rank = {w.encode(): i for w, i in rank.items()}
        self.templates, self.window = [], []
        by_word: dict[str, list[int]] = {}
        for label, texts in templates.items():
            for t in texts:
                ordered = sorted(set(t.split()), key=rank.__getitem__)
                needed = -(-percent * len(ordered) // 100)
                for w in ordered[: len(ordered) - needed + 1]:
                    by_word.setdefault(w, []).append(len(self.templates))
                self.templates.append((label, [rank[w] for w in ordered], needed))
                self.window.append(len(t.split()) * 5 // 4)
        self.prefix = list(by_word.values())
        self.hashes = H.words([w.encode() for w in by_word], H.NOT_ALNUM)[0]
        self.by_hash = dict(zip(H.words([w.encode() for w in rank], H.NOT_ALNUM)[0].tolist(), rank.values(), strict=True))

    def matches(self, block: set[bytes], chosen: list[int]) -> Iterator[tuple[str, float]]:
        """(label, containment) of the chosen templates that the block contains enough of."""
        own = sorted(self.rank[w] for w in block if w in self.rank)
        place = {r: i for i, r in enumerate(own)}
        for t in chosen:
            label, ordered, needed = self.templates[t]
            if len(block) < needed:
                continue
            i = next((i for i, r in enumerate(ordered) if r in place), None)
            if i is None or min(len(ordered) - i, len(own) - place[ordered[i]]) < needed:
                continue
            common = sum(r in place for r in ordered)
            if common >= needed:
                yield label, common / len(ordered)

    def window_match(self, h: np.ndarray, t: int, hits: list[int], low: int, high: int) -> tuple[str, float] | None:
        """(label, greatest containment) of template t in windows about its prefix words in words low to high of h, if enough."""
        label, ordered, needed = self.templates[t]
        wanted, width, best, at = set(ordered), self.window[t], 0, 0
        while at < len(hits):
            # Hits whose windows may overlap are looked at together.
            to = at + 1
            while to < len(hits) and hits[to] - hits[to - 1] < 2 * width:
                to += 1
            a, z = max(low, hits[at] - width + 1), min(high, hits[to - 1] + width)
            at = to
            if z - a < needed:
                continue
            places = [(i, r) for i, x in enumerate(h[a:z].tolist()) if (r := self.by_hash.get(x)) in wanted]
            if len({r for _, r in places}) < needed:
                continue
            count: dict[int, int] = {}
            first = 0
            for i, r in places:
                count[r] = count.get(r, 0) + 1
                while places[first][0] <= i - width:
                    gone = places[first][1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                    first += 1
                best = max(best, len(count))
        return (label, best / len(ordered)) if best >= needed else None


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row a text: its words, the places of phrases, the labels of phrases and of template blocks, the best containment."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    join = Join(templates, frequencies(docs, sorted({w for ts in templates.values() for t in ts for w in t.split()})), percent)
    wanted = [(H.words([p.encode()], H.NOT_ALNUM)[0], label) for p, label in phrases.items()]

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, part in H.groups(b.column(1).to_pylist()):
            h, first, starts, ends, buffer = H.words(part, H.NOT_ALNUM)
            k = len(part)
            n_base, low, high = np.zeros(k, np.int64), [None] * k, [None] * k
            base: list[set[str]] = [set() for _ in range(k)]
            found: list[set[str]] = [set() for _ in range(k)]
            score = np.zeros(k)
            for phrase, label in wanted:
                m = len(phrase)
                if len(h) < m:
                    continue
                same = h[: len(h) - m + 1] == phrase[0]
                for i in range(1, m):
                    same &= h[i : len(h) - m + 1 + i] == phrase[i]
                for w in np.flatnonzero(same).tolist():
                    t = int(np.searchsorted(first, w, side="right")) - 1
                    if w + m <= first[t + 1]:
                        n_base[t] += 1
                        i = w - int(first[t])
                        low[t] = i if low[t] is None else min(low[t], i)
                        high[t] = i if high[t] is None else max(high[t], i)
                        base[t].add(label)
                        score[t] = 1.0
            # Prefix filter: only blocks with one of the rarest words of a template are looked at.
            blocks: dict[tuple[int, int, int], set[int]] = {}
            hits: dict[tuple[int, int], list[int]] = {}
            for word, chosen in zip(join.hashes, join.prefix, strict=True):
                for w in np.flatnonzero(h == word).tolist():
                    t = int(np.searchsorted(first, w, side="right")) - 1
                    for c in chosen:
                        hits.setdefault((t, c), []).append(w)
                    s = int(starts[w])
                    begin, end = int(starts[first[t]]), int(ends[first[t + 1] - 1])
                    a = max(buffer.rfind(b"\n", begin, s), begin)
                    z = buffer.find(b"\n", s, end)
                    blocks.setdefault((t, a, end if z < 0 else z), set()).update(chosen)
            for (t, a, z), chosen in blocks.items():
                for label, share in join.matches(set(_WORD.findall(buffer[a:z])), sorted(chosen)):
                    found[t].add(label)
                    score[t] = max(score[t], share)
            for (t, c), at_words in hits.items():
                if (match := join.window_match(h, c, sorted(at_words), int(first[t]), int(first[t + 1]))) is not None:
                    found[t].add(match[0])
                    score[t] = max(score[t], match[1])
            texts = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, k), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()), texts(base), texts(x | y for x, y in zip(base, found, strict=True)), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return arrow_pass(docs, id_and_text(), _SCHEMA, batch)
