"""Toxicity (operator 5): Levenshtein automata intersected with a lexicon trie, and context windows.

Learning counts, over a bounded sample of labelled training rows, in how many toxic and other texts each word
and each word beginning stands.  Copies of one text count once.  Words, and beginnings shared by several
words (stems), which toxic texts hold far more often than chance allows make the lexicon: a trie whose nodes
say whether a word, or any word with this beginning, is a term, and the share of toxic texts among its texts.

Scoring takes each distinct word of a group of texts once.  Sets of letters rule out most words; for the
others the Levenshtein automaton of the word (distance 1 from five letters on) is intersected with the trie.
A hit counts less if it is a misspelling, and less if its context window quotes it: quotation marks around it
or a word of reporting before it.  The score is one less the product of the complements of all hits' weights.

Null and empty texts, and texts without a hit, have score 0.  Every row is scored, repeated ones each;
extra columns are ignored.  Words have any length: stems are looked up in all of them, the automaton runs where the
length admits a term.  Very long texts are scored whole, a million bytes or one text at a time.  Ids whose labels
disagree teach nothing; of rows with one doc_id the text of least hash does.  Terms of equal evidence go by their
letters.  Without labelled training rows of both kinds the lexicon is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm import hashing as H
from basaltql.llm.common import Scratch, arrow_pass, held_out, id_and_text, labelled, texts_of

#: The bound of the labelled sample; the lexicon holds no more than the words of its toxic texts.
TRAINING_ROWS = 8_000
#: A term's texts must be so unlikely by chance (negative logarithm), and toxic in this share.
EVIDENCE, PRECISION = 12.0, 0.93
STEMS = range(4, 9)
WINDOW_BYTES, QUOTED, MISSPELLED, THRESHOLD = 48, 0.25, 0.85, 0.7
_MARKS = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Words that announce a quotation.
_REPORTING = {"said", "says", "wrote", "writes", "called", "word", "term", "quote", "quoted", "insult", "schrieb", "sagte", "wort", "mot", "dit", "palabra", "dijo"}


class Trie:
    """Terms with weights.  A node: [children by letter, weight of the word that ends here, weight of the stem]."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.root: list = [{}, 0.0, 0.0]
        #: No longer word can be within a distance beyond it.
        self.longest = max((len(t) for t, stem, _ in terms if not stem), default=0)
        for term, stem, weight in terms:
            node = self.root
            for c in term:
                node = node[0].setdefault(c, [{}, 0.0, 0.0])
            node[2 if stem else 1] = max(node[2 if stem else 1], weight)

    def best(self, word: str, distance: int) -> tuple[float, int]:
        """(weight, edits) of the best term within the distance of the word; a stem must stand unchanged."""
        best = (0.0, 0)
        node = self.root
        for c in word:
            if (node := node[0].get(c)) is None:
                break
            best = max(best, (node[2], 0))
        n = len(word)
        if n > self.longest + distance:
            return best[0], 0
        # States of the automaton: the row of edit distances between the trie's path and the word's beginnings.
        stack = [(self.root, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            if node[1] and row[n] <= distance:
                best = max(best, (node[1] * (MISSPELLED if row[n] else 1.0), -row[n]))
            for c, child in node[0].items():
                last = row[0] + 1
                new = [last]
                for j in range(n):
                    last = min(last + 1, row[j + 1] + 1, row[j] + (word[j] != c))
                    new.append(last)
                if min(new) <= distance:
                    stack.append((child, new))
        return best[0], -best[1]


def _letters(text: bytes) -> int:
    mask = 0
    for c in text:
        mask |= 1 << (c & 63)
    return mask


class Lexicon:
    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms, self.trie = terms, Trie(terms)
        words = [t.encode() for t, stem, _ in terms if not stem]
        self.length = np.array([len(w) for w in words], np.int64)
        self.mask = np.array([_letters(w) for w in words], np.uint64)
        self.head = np.array([w[0] << 8 | w[1] if len(w) > 1 else -1 for w in words], np.int64)
        self.tail = np.array([w[-2] << 8 | w[-1] if len(w) > 1 else -1 for w in words], np.int64)
        self.weights: dict[bytes, float] = {}
        self.wide = np.array([not w.isascii() for w in words], bool)
        self.exact = np.sort(self._hash([w for w in words if len(w) < 5]))
        self.stems = {n: np.sort(self._hash([t.encode() for t, stem, _ in terms if stem and len(t.encode()) == n])) for n in {len(t.encode()) for t, stem, _ in terms if stem}}

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        return H.words(words, H.NOT_ALNUM)[0]

    def possible(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Which distinct words can be near a term: by stem, by hash, or by length and set of letters."""
        n = ends - starts
        near = np.isin(h, self.exact)
        for k, known in self.stems.items():
            long = np.flatnonzero(n >= k)
            if len(long):
                begin = np.zeros(len(long), np.uint64)
                power, _ = H._power_tables(k + 1)
                for i in range(k):
                    begin += H._BYTE[a[starts[long] + i]] * power[i]
                near[long[np.isin(H.mix(begin), known)]] = True
        bits = np.uint64(1) << (a & np.uint8(63)).astype(np.uint64)
        mask = np.zeros(len(n), np.uint64)
        fits = np.flatnonzero(n <= self.length.max(initial=0) + 4)  # a longer word is near no term
        for i in range(int(n[fits].max(initial=0))):
            fits = fits[n[fits] > i]
            mask[fits] |= bits[starts[fits] + i]
        high = np.concatenate([[0], np.cumsum(a >= 0x80)])
        wide = high[ends] > high[starts]
        head, tail = a[starts].astype(np.int64) << 8 | a[np.minimum(starts + 1, len(a) - 1)], a[np.maximum(ends - 2, 0)].astype(np.int64) << 8 | a[ends - 1]
        for length, term, first, last, other in zip(self.length, self.mask, self.head, self.tail, self.wide, strict=True):
            # One edit leaves one end of the term as it is, and changes one letter or, of non-ASCII words, a few bytes.
            loose = wide | other
            some = np.flatnonzero(((head == first) | (tail == last)) & (np.abs(n - length) <= 1 + loose) & ~near)
            near[some[np.bitwise_count(mask[some] ^ term) <= 2 + 2 * loose[some]]] = True
        return near

    def weight(self, raw: bytes) -> float:
        """The weight of a word; a worker remembers a bounded number of them."""
        if raw not in self.weights:
            if len(self.weights) >= 100_000:
                self.weights.clear()
            w = raw.decode("utf-8", "replace")
            self.weights[raw] = self.trie.best(w, int(len(w) >= 5))[0]
        return self.weights[raw]

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for _, part in H.groups(texts):
            h, first, starts, ends, buffer = H.words(part, H.NOT_ALNUM)
            clean = np.ones(len(part))
            if len(h) and self.terms:
                _, at, back = np.unique(h, return_index=True, return_inverse=True)
                near = np.flatnonzero(self.possible(h[at], starts[at], ends[at], np.frombuffer(buffer, np.uint8)))
                weight = np.zeros(len(at))
                for i in near:
                    weight[i] = self.weight(buffer[starts[at[i]] : ends[at[i]]])
                hits = np.flatnonzero(weight[back])
                text = np.searchsorted(first, hits, side="right") - 1
                for i, t in zip(hits.tolist(), text.tolist(), strict=True):
                    begin = starts[first[t]]
                    w = weight[back[i]] * (QUOTED if quoted(buffer, int(starts[i]), int(ends[i]), int(begin), int(ends[first[t + 1] - 1])) else 1.0)
                    clean[t] *= 1.0 - w
            out += (1.0 - clean).tolist()
        return out


def quoted(buffer: bytes, start: int, end: int, low: int, high: int) -> bool:
    """Whether the window around a hit quotes it: marks that open before and close after it, or a reporting word before it."""
    before = buffer[max(low - 3 if low >= 3 else 0, start - WINDOW_BYTES) : start].decode("utf-8", "ignore")
    after = buffer[end : min(high + 3, end + WINDOW_BYTES)].decode("utf-8", "ignore")
    for opening, closing in _MARKS.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return any(w in _REPORTING for w in "".join(c if c.isalnum() else " " for c in before).split()[-3:])


def _choose(counts: list[tuple[str, bool, int, int, int]], toxic: int, other: int) -> list[tuple[str, bool, float]]:
    """Terms from (text, stem, toxic texts, other texts, continuations)."""
    rate = toxic / max(1, toxic + other)
    good = []
    for text, stem, a, b, kinds in counts:
        share = (a + 0.5) / (a + b + 1.0)
        if a < 3 or a / (a + b) < PRECISION or stem and kinds < 3:
            continue
        # The divergence of the share of toxic texts from the rate, times the number of texts.
        p = a / (a + b)
        evidence = a * np.log(p / rate) + (b * np.log((1 - p) / (1 - rate)) if b else 0.0)
        if evidence >= EVIDENCE:
            good.append((evidence, text, stem, share))
    good.sort(key=lambda g: (-g[0], g[1], g[2]))
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    for _, text, stem, share in good:
        if not any(text[:k] in stems for k in STEMS):
            chosen.append((text, stem, float(share)))
            if stem:
                stems.add(text)
    return chosen


def _stems(words: set[str]) -> set[tuple[str, bool]]:
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def _words(text: str | None) -> list[str]:
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace")
    return [w for w in "".join([c if c.isalnum() else " " for c in low]).split()]


def _family(words: list[str]) -> int:
    """The least hash of five words in a row, which copies of a text share as a rule."""
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))), default=0)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of at most TRAINING_ROWS labelled rows outside the held-out third, the least by hash of their id."""
    spark = docs.sparkSession
    texts = texts_of(docs, labelled(labels, "toxic").orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS))

    def vocabulary(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [_words(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(map(_family, words), pa.int64()), pa.array([sorted(set(x)) for x in words], pa.list_(pa.string()))], ["toxic", "family", "words"])

    scratch = Scratch(spark)
    made = arrow_pass(texts, [F.col("text"), F.col("label")], "toxic int, family long, words array<string>", vocabulary)
    sample = scratch.keep(made.groupBy("family", "toxic").agg(F.min("words").alias("words")))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon([])

    def in_toxic(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        kinds: dict[str, set[str]] = {}
        for words in b.column(0).to_pylist():
            count.update(_stems(set(words)))
            for w in words:
                for k in STEMS:
                    if len(w) > k and len(some := kinds.setdefault(w[:k], set())) < 3:
                        some.add(w)
        terms = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms]), pa.array([s for _, s in terms]), pa.array([count[t] for t in terms], pa.int64()), pa.array([sorted(kinds[t]) if s else [] for t, s in terms], pa.list_(pa.string()))], ["text", "stem", "n", "kinds"])

    toxic = arrow_pass(sample.where("toxic = 1"), [F.col("words")], "text string, stem boolean, n long, kinds array<string>", in_toxic, whole=True)
    toxic = toxic.groupBy("text", "stem").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")).where("n >= 3 and (not stem or kinds >= 3)")
    found = {(r.text, r.stem): (r.n, r.kinds) for r in toxic.collect()}  # bounded by the words of TRAINING_ROWS texts
    wanted = spark.sparkContext.broadcast(frozenset(found))

    def in_others(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for words in b.column(0).to_pylist():
            count.update(_stems(set(words)) & wanted.value)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in count]), pa.array([s for _, s in count]), pa.array(list(count.values()), pa.int64())], ["text", "stem", "n"])

    others = arrow_pass(sample.where("toxic = 0"), [F.col("words")], "text string, stem boolean, n long", in_others, whole=True)
    against = {(r.text, r.stem): r.n for r in others.groupBy("text", "stem").agg(F.sum("n").alias("n")).collect()}
    scratch.drop(sample)
    return Lexicon(_choose([(text, stem, n, against.get((text, stem), 0), kinds) for (text, stem), (n, kinds) in found.items()], sizes[1], sizes[0]))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = lexicon.scores(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return arrow_pass(docs, id_and_text((held_out().alias("held_out"),)), "doc_id long, held_out boolean, score double, predicted int", batch)


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the rows that score THRESHOLD or more: one Arrow pass over all columns, without a join."""
    place = docs.columns.index("text")

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        clean = [x < THRESHOLD for x in lexicon.scores(b.column(place).to_pylist())]
        yield b.filter(pa.array(clean, pa.bool_()))

    return arrow_pass(docs, [docs[c] for c in docs.columns], docs.schema, batch)
