"""Defined results in odd cases, and operators against brute force: batches, repeats, ties, clashes, caps."""

import random
from collections import Counter

import numpy as np
import pytest

from basaltql.llm import chat, common, components, decontam, langid, license_scan, merkle, neardup, quality, substring, toxicity
from basaltql.llm.common import Scratch
from basaltql.llm import hashing as H

R = random.Random(23)
WORDS = ["".join(R.choice("abcdefghijklmnopqrst") for _ in range(R.randint(2, 8))) for _ in range(1200)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def passages(spark, docs, **kw):
    return sorted(tuple(r) for r in substring.repeated_passages(spark, docs, **kw).collect())


@pytest.fixture(scope="module")
def mixed():
    """Documents that share whole, partial, nested and changed passages, common lines, and rows that repeat."""
    r = random.Random(77)
    pool, line = [prose(r.randint(55, 120), r) for _ in range(12)], prose(9, r)
    rows = []
    for i in range(90):
        parts = [prose(r.randint(20, 80), r)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool).split()
            if r.random() < 0.3:
                p = p[r.randrange(0, 20) :]
            if r.random() < 0.3:
                for k in r.sample(range(len(p)), len(p) // 12):
                    p[k] = r.choice(WORDS)
            parts += [" ".join(p), line if r.random() < 0.8 else "", prose(r.randint(5, 40), r)]
        rows.append((i, " ".join(parts)))
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (8, rows[30][1]), (None, rows[3][1]), (200, None), (201, "")]


@pytest.mark.parametrize(("parts", "batch", "hot"), [(1, 10_000, 256), (7, 10, 256), (50, 10, 3), (7, 50, 12)])
def test_passages_do_not_depend_on_batches(spark, mixed, parts, batch, hot, monkeypatch):
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    want = passages(spark, docs.coalesce(1))
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert passages(spark, docs.repartition(parts)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_exact_passages_against_brute_force(spark, mixed):
    """Every word of a run of 60 or more that an earlier document has is covered; what is reported is shared for the most part."""
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    found: dict[int, set[int]] = {}
    for doc, _, a, z, *_ in passages(spark, docs):
        found.setdefault(doc, set()).update(range(a, z))
    seen_long, seen_short, missed, all_ = set(), set(), 0, 0
    for doc, text in sorted({x for x in mixed if x[0] is not None and x[0] != 8 and x[1]}):  # 8 has two texts
        w, got = text.split(), found.get(doc, set())
        run = {k + j for k in range(len(w) - 59) if tuple(w[k : k + 60]) in seen_long for j in range(60)}
        all_ += len(run)
        missed += len(run - got)
        near = {k + j for k in range(len(w) - 4) if tuple(w[k : k + 5]) in seen_short for j in range(5)}
        assert len(got & near) >= 0.6 * len(got)
        seen_long.update(tuple(w[k : k + 60]) for k in range(len(w) - 59))
        seen_short.update(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    assert all_ > 2000 and missed <= 0.01 * all_


def test_a_source_that_is_neither_first_nor_last(spark):
    r = random.Random(3)
    p = prose(80, r)
    words = p.split()
    pieces = [" ".join(words[k : k + 10]) for k in range(0, 80, 10)]
    texts = [f"{prose(30, r)} {x} {prose(30, r)}" for x in pieces]  # every piece stands in a document of its own
    texts += [f"{prose(25, r)} {p} {prose(25, r)}"]
    texts += [f"{prose(30, r)} {x} {prose(30, r)}" for x in pieces]
    texts += [f"{prose(45, r)} {p} {prose(15, r)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x[0]: x for x in passages(spark, docs)}
    assert got[17][2] <= 50 and got[17][3] >= 120 and got[17][5] == 8


def test_removal_with_repeated_ids(spark):
    r = random.Random(5)
    shared, other = prose(100, r), prose(80, r)
    rows = [(1, f"{shared} {prose(40, r)}"), (2, f"{prose(30, r)} {shared} {prose(20, r)}"), (2, f"{other} {prose(100, r)}"), (2, "short"), (3, f"{shared}"), (3, f"{shared}")]
    docs = spark.createDataFrame([(i, t, len(t), "a", "b") for i, t in rows], "doc_id long, text string, n_chars long, spots_0 string, key_0 string")
    got = sorted(tuple(x) for x in substring.remove_repeated(spark, docs).collect())
    assert len(got) == 4 and {(1, rows[0][1]), (2, rows[2][1]), (2, "short")} <= {x[:2] for x in got}
    assert min(len(x[1].split()) for x in got if x[0] == 2 and x[1] != "short") == 50


def test_clashing_columns(spark):
    r = random.Random(9)
    extra = ["__id", "__gone", "__leak", "__toxic", "gone_0", "id", "label", "spots", "version", "key", "component_id", "kept", "n_shingles", "held_out", "score", "shingle", "words"]
    rows = [(i, prose(40, r), *["x"] * len(extra)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(30)], "doc_id long, toxic int, quality int, text string")
    items = spark.createDataFrame([(1, rows[4][1], "x", 5)], "item_id long, text string, shingle string, doc_id long")
    assert neardup.keep_one_of_each(spark, docs).columns == docs.columns
    assert {x.doc_id for x in decontam.remove_contaminated(spark, docs, items).collect()} == set(range(30)) - {4}
    assert substring.remove_repeated(spark, docs).count() == 30
    assert toxicity.keep_clean(docs, toxicity.learn(docs, labels)).columns == docs.columns
    assert quality.score(docs, quality.fit(docs, labels)).count() == 30


def test_labels_that_disagree_and_repeated_ids(spark):
    r = random.Random(12)
    made = [(i, prose(40, r) + (" grimble" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(i, "another text") for i in range(0, 300, 7)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in made] + [(i, 1 - y, 1 - y) for i, _, y in made[:40]], "doc_id long, toxic int, quality int")
    used = {x.id for x in common.labelled(labels, "toxic").collect()}
    assert used and min(used) >= 40
    terms, votes = set(), set()
    for n in (1, 5, 9):
        d, y = docs.repartition(n), labels.repartition(n)
        terms.add(tuple(toxicity.learn(d, y).terms))
        votes.add(tuple(np.round(quality.fit(d, y).scores([t for _, t, _ in made[:30]]), 4)))
    assert len(terms) == 1 and len(votes) == 1 and "grimble" in {t for x in terms for t, *_ in x}


def test_words_of_any_length():
    term = "".join(R.choice("abcdefg") for _ in range(60))
    lexicon = toxicity.Lexicon([(term, False, 0.9), ("schurk", True, 0.95)])
    s = lexicon.scores([term, term[:-1], "schurk" + "x" * 90, "schurkerei", "y" * 200])
    assert s[0] > s[1] > 0 and s[2] == s[3] > 0 and s[4] == 0


def test_toxicity_scores_against_plain_search():
    r = random.Random(8)
    terms = [("".join(r.choice("abcd") for _ in range(r.randint(4, 7))), False, 0.9 - k / 100) for k in range(8)] + [("zzza", True, 0.8)]
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def plain(text):
        clean = 1.0
        for w in text.split():
            weights = [wt for t, stem, wt in terms if (w.startswith(t) if stem else w == t)]
            weights += [wt * toxicity.MISSPELLED for t, stem, wt in terms if not stem and len(w) >= 5 and w != t and distance(w, t) <= 1]
            clean *= 1 - max(weights, default=0)
        return 1 - clean

    texts = [" ".join("".join(r.choice("abcdz") for _ in range(r.randint(3, 8))) for _ in range(30)) for _ in range(40)]
    texts += [" ".join(["zzzab", terms[0][0], "q" * 300])]
    assert np.allclose(lexicon.scores(texts), [plain(t) for t in texts])


def test_ties_of_neighbours():
    texts = [prose(50) for _ in range(12)]
    x = quality.features(texts * 3)
    label = np.array([0.0, 1.0, 1.0] * 12)

    def model(order):
        m = quality.Model(np.ones(quality.FEATURES, np.float32), np.eye(quality.FEATURES, 20, dtype=np.float32), np.zeros(0), label[order])
        m.known = m.latent(x[order])
        return m

    every = [model(np.random.default_rng(k).permutation(36)).scores(texts) for k in range(4)]
    assert all(np.allclose(every[0], e) for e in every)


def test_size_classes_miss_nothing(spark, monkeypatch):
    r = random.Random(15)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = [(k, prose(n, r)) for k, n in enumerate((5, 9, 20, 36, 37, 68, 132, 260, 700))]
    docs = []
    for k, t in items:
        w = t.split()
        keep = len(w) - 4 - (len(w) - 4) // 5 + 4
        docs += [(10 * k, f"{prose(60, r)} {' '.join(w[:keep])} {prose(30, r)}"), (10 * k + 1, " ".join(w[: max(4, keep - 2)])), (10 * k + 2, t)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    sets = lambda rows: {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    a, c = sets(docs), sets(items)
    want = {(i, j, len(a[i] & c[j])) for i in a for j in c if 100 * len(a[i] & c[j]) >= 80 * len(c[j])}
    assert {tuple(x)[:3] for x in decontam.contaminated(spark, d, b).collect()} == want and {(10 * k, k) for k, _ in items} <= {x[:2] for x in want}
    assert [decontam.registers(k) for k in range(7)] == [1, 3, 7, 15, 31, 36, 40]
    for m in (36, 60, 100):
        hits = np.random.default_rng(1).binomial(m, 0.8, 200_000)
        assert (hits < decontam.needed(m, 80)).mean() <= 2e-5 and decontam.needed(m, 80) > 0.3 * m


def test_merkle_locations_against_the_texts():
    r = random.Random(4)
    for _ in range(30):
        text = "\n".join(". ".join(prose(r.randint(3, 9), r) for _ in range(r.randint(1, 4))) + "." + ("\n" if r.random() < 0.2 else "") for _ in range(25))
        at = r.randrange(len(text))
        other = text[:at] + "CHANGED" + text[at + r.randint(0, 30) :]
        a, b = merkle.tree(text), merkle.tree(other)
        near, left, right = merkle.compare(a, b)
        cut = lambda t, spans: "".join(t[x:y] for x, y in zip([0, *(z for _, z in spans)], [*(x for x, _ in spans), len(t)], strict=True))
        assert cut(text, left) == cut(other, right)
        assert any(x <= at <= y for x, y in right) and near > 0.5
        # The likeness is the share of characters outside the ranges.
        outside = len(text) + len(other) - sum(z - x for x, z in [*left, *right])
        assert abs(near - outside / (len(text) + len(other))) < 1e-9


def test_language_distance_against_plain_ranks():
    r = random.Random(6)
    alphabets = {"aa": "abcdefg", "bb": "cdefghij"}
    learned = {k: " ".join("".join(r.choice(v) for _ in range(5)) for _ in range(300)) for k, v in alphabets.items()}

    def grams(text):
        out = Counter()
        for w in text.split():
            p = f"\0{w}\0"
            out.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n].strip("\0"))
        return out

    profiles = {k: langid.ranked(*np.unique(langid.grams(t), return_counts=True)) for k, t in learned.items()}
    codes = {k: {int(c): i for i, c in enumerate(p)} for k, p in profiles.items()}
    p = langid.Profiles(profiles)
    for _ in range(40):
        text = " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(r.randint(1, 30)))
        mine = langid.ranked(*np.unique(langid.grams(text), return_counts=True)).tolist()
        assert len(mine) == min(langid.PROFILE, len(grams(text)))
        far = {k: sum(abs(c[g] - i) if g in c else langid.PROFILE for i, g in enumerate(mine)) for k, c in codes.items()}
        lang, score = p.predict(text)
        assert lang == min(far, key=lambda k: (far[k], k)) and abs(score - (1 - far[lang] / (langid.PROFILE * len(mine)))) < 1e-9


def test_license_windows_against_all_windows(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = {f"t{i}": [" ".join(r.sample(vocabulary, 8))] for i in range(5)}
    texts = []
    for _ in range(120):
        w = [r.choice(vocabulary) for _ in range(30)]
        t = templates[f"t{r.randrange(5)}"][0].split()
        r.shuffle(t)
        w[10 : 10 + r.randint(5, 8)] = t
        texts.append(" \n".join(w))
    join = license_scan.Join(templates, {}, 90)
    want = []
    for text in texts:
        w, found = text.split(), set()
        for t, (label, ordered, needed) in enumerate(join.templates):
            words = set(templates[label][0].split())
            if any(len(words & set(w[k : k + join.window[t]])) >= needed for k in range(len(w))):
                found.add(label)
        want.append(",".join(sorted(found)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.labels for x in license_scan.scan(docs, templates, {"no such phrase": "x"}, 90).collect()}
    assert [got[i] for i in range(len(texts))] == want and any(want)


def test_long_conversations(spark):
    rows = [(1, k, "user", f"{k} " * 50) for k in range(300)] + [(2, k, "user", f"{k} " * 50) for k in range(299)] + [(3, 0, "user", "z" * 200_000)]
    got = {x.conv_id: (x.n_turns, len(x.rendered)) for x in chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1][0] == 300 and got[3][1] > 200_000


def test_very_long_texts_have_passages(spark):
    r = random.Random(19)
    p = prose(200, r)
    docs = spark.createDataFrame([(1, f"{prose(40_000, r)} {p} {prose(40_000, r)}"), (2, f"{prose(30_000, r)} {p}")], "doc_id long, text string")
    assert [x[:1] + x[2:6] for x in passages(spark, docs)] == [(2, 30_000, 30_200, 200, 1)]


def test_sides_and_keys_are_those_of_the_words():
    text = " ".join(f"x{i}" for i in range(200)).encode()
    o = substring.occurrences(np.array([4]), np.array([0]), [text], 5)
    assert len(o[0]) > 30 and all(len(x) == len(o[0]) for x in o)
    far = o[5] >> np.uint64(substring.BITS * substring.SIDE)
    assert ((far > 0) == (o[3] + 5 + substring.WIDE <= 200)).all()
    assert (H.words([text])[0].shape[0]) == 200


def _components_by_hand(links: list[tuple[int, int]]) -> dict[int, int]:
    least = {x: x for link in links for x in link}
    while True:
        after = dict(least)
        for a, b in links:
            after[a] = after[b] = min(after[a], after[b])
        if after == least:
            return least
        least = after


def test_components_of_paths_stars_and_random_links(spark):
    """Chains, stars at the least and at the greatest node (both hot), random links, repeats and loops."""
    rng = np.random.default_rng(11)
    chain = rng.permutation(300).tolist()
    cases = {
        "chain": list(zip(chain, chain[1:], strict=False)),
        "low star": [(1000, x) for x in range(1001, 1400)],
        "high star": [(2999, x) for x in range(2500, 2900)],
        "random": rng.integers(4000, 4400, (350, 2)).tolist(),
        "loops": [(5000, 5000), (5001, 5001), (5002, 5001), (5001, 5002)],
    }
    links = [(int(a), int(b)) for part in cases.values() for a, b in part]
    want = _components_by_hand([x for x in links if x[0] != x[1]])
    scratch = Scratch(spark)
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = components.connected_components(spark, table, scratch).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(want.items())
    scratch.clear()


def test_components_of_no_links(spark):
    scratch = Scratch(spark)
    assert components.connected_components(spark, spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), scratch).count() == 0
    scratch.clear()
