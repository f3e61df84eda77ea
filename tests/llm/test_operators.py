"""Each operator against a plain version on small tables: copies, nulls, empty and long texts, repeats, odd columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltql.llm import bpe, chat, common, decontam, langid, license_scan, merkle, neardup, quality, substring, toxicity
from basaltql.llm import hashing as H
from basaltql.llm.queries import vocabulary

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 7))) for _ in range(900)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, seed string"


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text, n):
    words = text.split()
    for i in R.sample(range(len(words)), n):
        words[i] = R.choice(VOCABULARY)
    return " ".join(words)


def corpus():
    texts = [prose(R.randint(30, 200)) for _ in range(40)]
    base = prose(300)
    texts += [base, base, base, *(changed(base, n) for n in (1, 2, 3, 4, 6, 8, 10, 14, 20, 60))]
    texts += [None, "", " \n ", "one two", "one two", prose(3), "ZWÖLF Boxkämpfer", prose(20_000), "퟿\U0001f600 é" * 50]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(3, texts[1]), (None, "no id " * 30), (-7, base)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_against_the_library(docs, rows, nothing):
    import tiktoken

    path, pattern = vocabulary()
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {(r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(docs, path, pattern).collect()}
    want = set()
    for _, t in rows:
        ids = library.encode_ordinary(t or "")
        want.add((hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    codec = bpe.codec(path, pattern)
    for piece in (b"a" * 300, "ß€😀".encode() * 40, bytes(range(256)), b"abcabcab"):
        assert codec.decode(bpe.merge_piece(piece, codec.ranks)) == piece
        assert bpe.merge_piece(piece, codec.ranks) == library._encode_single_piece(piece) or piece in codec.ranks
    assert bpe.round_trip(nothing, path, pattern).count() == 0
    assert {tuple(r.ids) for r in bpe.encode_documents(docs.where("doc_id = 3"), path, pattern).collect()} == {tuple(library.encode_ordinary(rows[1][1]))}


def test_merkle(spark, docs, rows, nothing):
    got = merkle.compare_with_next(spark, docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        t, following = t or "", following or ""
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in merkle.fingerprints(docs).collect():
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert len(by_text) == len({t or "" for _, t in rows})
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert merkle.compare_with_next(spark, nothing).count() == 0
    a, b = merkle.tree("One. Two.\nThree.\n\nFour."), merkle.tree("One. Two.\nThree!\n\nFour.")
    assert merkle.likeness(a, a) == 1 and 0.5 < merkle.likeness(a, b) < 1


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("block", "hot"), [(neardup.BLOCK, common.HOT_ROWS), (4, 1)])
def test_near_duplicates_against_all_pairs(spark, docs, rows, nothing, block, hot, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    sets = shingle_sets([r for r in rows if r[0] is not None], 4)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark, docs, width=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))
    assert neardup.near_duplicates(spark, nothing).count() == 0
    kept = neardup.keep_one_of_each(spark, docs, width=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_spread_join(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 2), (3, 1), (None, 4)) for i in range(n)], "k long, i int")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d"), (None, "n")], "k long, x string")
    got = sorted((r.k, r.i, r.x) for r in common.spread_join(left, right, "k", left.count()).collect())
    assert got == [(1, i, "a") for i in range(9)] + [(3, 0, "c")]


def test_large_families_against_all_pairs(spark, monkeypatch):
    """Families of several blocks, with members near to and far from their first document."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):
        w = list(base)
        for p in r.sample(range(100), (0, 1, 2, 3, 6)[i % 5]):
            w[p] = f"x{r.randrange(30)}"
        texts.append(" ".join(w))
    sets = shingle_sets([(i, t) for i, t in enumerate(texts)], 4)
    root = {i: i for i in sets}
    for _ in root:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(spark, docs, width=4).collect()} == root


def test_sketches_estimate_and_merge():
    a, b = np.arange(2000, dtype=np.uint64), np.arange(200, 2200, dtype=np.uint64)
    a, b = H.mix(a + np.uint64(1)), H.mix(b + np.uint64(1))
    s = neardup.registers(np.concatenate([a, b]), np.array([0, 2000]))
    n = np.array([2000.0])
    assert abs(neardup.estimate(s[:1], s[1:], n, n)[0] - 1800 / 2200) < 0.15
    assert (neardup.merge(s[0], s[1]) == neardup.registers(np.concatenate([a, b]), np.array([0]))[0]).all()


def test_contamination_against_sets(spark, rows, nothing):
    items = [(1, prose(40)), (2, prose(12)), (3, "too short"), (4, None), (5, prose(60)), (5, prose(8))]
    planted = [(1000, f"{prose(500)} {items[0][1].upper()}! {prose(400)}"), (1001, items[1][1]), (1002, " ".join(items[4][1].split()[:56])), (1003, " ".join(items[0][1].split()[:20]))]
    every = rows + planted
    docs = spark.createDataFrame([(i, t, 0) for i, t in every], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")

    def sets(pairs):
        out = {}
        for i, t in pairs:
            w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
            if i is not None:
                out.setdefault(i, set()).update(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return out

    d, b = sets(every), sets(items)
    want = {(i, j, len(d[i] & b[j]), len(b[j])) for i in d for j in b if b[j] and 100 * len(d[i] & b[j]) >= 80 * len(b[j])}
    assert {tuple(r)[:4] for r in decontam.contaminated(spark, docs, benchmark).collect()} == want and (1000, 1) in {w[:2] for w in want}
    assert {r.doc_id for r in decontam.remove_contaminated(spark, docs, benchmark).collect()} == {i for i, _ in every} - {w[0] for w in want}
    assert decontam.contaminated(spark, docs, benchmark.limit(0)).count() == 0
    assert decontam.contaminated(spark, nothing, benchmark).count() == 0


def test_toxicity(spark, docs, nothing):
    made = []
    for i in range(400):
        t = prose(40)
        if bad := i % 4 == 0:
            w = t.split()
            w[7] = R.choice(["zornig", "quatsch", "vrax" + R.choice(VOCABULARY)])
            t = " ".join(w)
        made.append((i, t, int(bad)))
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in made], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    lexicon = toxicity.learn(d, labels)
    assert {"zornig", "quatsch"} <= {t for t, stem, _ in lexicon.terms} and any(stem and "vrax".startswith(t[:4]) for t, stem, _ in lexicon.terms)
    got = {r.doc_id: r for r in toxicity.score(d, lexicon).collect()}
    held = [y for y in made if got[y[0]].held_out]
    assert 80 < len(held) < 190 and all(got[i].predicted == y for i, _, y in held)
    plain, misspelt, said = lexicon.scores(["du zornig du", "du zoornig du", 'er sagte "zornig" dann'])
    assert plain > misspelt > said > 0
    assert lexicon.scores([None, "", "kein Wort"]) == [0.0, 0.0, 0.0]
    assert {r.doc_id for r in toxicity.keep_clean(d, lexicon).collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(docs, toxicity.learn(nothing, labels)).where("score > 0").count() == 0
    assert toxicity.score(nothing, lexicon).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i + 1]
    for j, y in enumerate(b):
        new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
    return new


def test_automaton_and_filter_against_edit_distance():
    r = random.Random(2)
    terms = ["".join(r.choice("abcdé") for _ in range(r.randint(3, 8))) for _ in range(12)]
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(2, 9))) for _ in range(1500)]
    for t in terms:
        for _ in range(10):
            i = r.randrange(len(t))
            words += [t[:i] + r.choice("abcdé") + t[i + 1 :], t[:i] + t[i + 1 :], t[:i] + r.choice("abcdé") + t[i:]]
    words = [w for w in words if len(w) > 1]
    lexicon = toxicity.Lexicon([(t, False, 0.9) for t in terms])
    for w, s in zip(words, lexicon.scores(words), strict=True):
        assert (s > 0) == any(w == t if len(w) < 5 else distance(w, t) <= 1 for t in terms if len(t) >= 5 or w == t or len(w) >= 5), w


def test_license_scan(spark, docs, rows, nothing):
    texts = ["Released under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0. Apache License version 2", "This work is licensed under the GNU General Public License, version 3.", "mit license the under", "CC BY NC cc by nc", None, "éa b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in license_scan.scan(d).collect()}
    assert got[0] == (6, 1, 1, 1, "mit", "mit")
    assert got[1][1:] == (2, 3, 8, "apache-2", "apache-2")
    assert got[2][1:] == (0, None, None, "", "gpl-3")
    assert got[3][1:] == (0, None, None, "", "")
    assert got[4] == (6, 2, 0, 3, "cc-by-nc", "cc-by-nc")
    assert got[5] == (0, 0, None, None, "", "") and got[6][0] == 2
    assert license_scan.scan(docs).count() == len(rows) and license_scan.scan(nothing).count() == 0


def test_set_join_against_all_blocks():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{i}": [" ".join(r.sample(vocabulary, r.randint(3, 9)))] for i in range(8)}
    join = license_scan.Join(templates, {w: r.randrange(50) for w in vocabulary}, 80)
    for _ in range(400):
        block = {w.encode() for w in r.sample(vocabulary, r.randint(1, 25))}
        chosen = sorted({t for h, ts in zip(join.hashes, join.prefix, strict=True) for t in ts if h in set(H.words(list(block), H.NOT_ALNUM)[0])})
        want = {k for k, (t,) in templates.items() if 100 * len({w.encode() for w in t.split()} & block) >= 80 * len(set(t.split()))}
        assert {label for label, _ in join.matches(block, chosen)} == want


def test_chat(spark):
    talk = {1: "abc", 2: "ab", 3: "abcd", 4: "abcd", 5: "x", 6: "abd"}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t, "z") for c, s in talk.items() for i, t in enumerate(s)]
    rows += [(7, 0, None, None, "z"), (8, 0, "", "", "z"), (None, 0, "user", "a", "z"), (5, 0, "user", "x", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, rendered string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(turns).collect()}
    assert set(got) == {3, 5, 6, 7, 8} and got[5] == (1, "<|user|>\nx\n") and got[7][1] == "<||>\n\n"
    assert chat.render(turns.limit(0)).count() == 0


def test_quality(spark, docs, rows, nothing):
    good = [prose(60) + ". " + prose(50) for _ in range(150)]
    bad = [" | ".join(prose(40).split()) if i % 2 else (R.choice(VOCABULARY) + " ") * 60 for i in range(150)]
    made = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in made], "doc_id long, text string, label string")
    model = quality.fit(d, spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [(got[i], y) for i, _, y in made if got[i].held_out]
    assert len(held) > 60 and sum(g.predicted == y for g, y in held) >= 0.97 * len(held)
    assert quality.score(docs, model).where("score between 0 and 1").count() == len(rows)
    assert abs(model.scores([None])[0] - model.label.mean()) < 1e-9
    assert [r.score for r in quality.score(docs.limit(1), quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))).collect()] == [0.5]
    # The blocked product is the plain one.
    x = quality.features([good[0], bad[0]])
    y = model.latent(x)
    cosine = np.array([[float(a @ b) for b in model.known] for a in y])
    near = [np.argsort(-c)[: quality.NEIGHBOURS] for c in cosine]
    plain = [np.average(model.label[n], weights=np.exp(quality.SHARPNESS * (c[n] - 1))) for c, n in zip(cosine, near, strict=True)]
    assert np.allclose(plain, model.scores([good[0], bad[0]]), atol=1e-3)


def test_language(spark, docs, rows, nothing):
    from collections import Counter

    alphabets = {"aa": "abcdefg", "bb": "efghijkl", "cc": "äöüabcé"}
    made = [(i, " ".join("".join(R.choice(alphabets[k]) for _ in range(5)) for _ in range(40)), k) for i in range(120) for k in [R.choice(list(alphabets))]]
    d = spark.createDataFrame([*made, (500, "abc", None), (501, None, "aa"), (502, "12 !", "bb")], "doc_id long, text string, lang string")
    profiles = langid.learn(d)
    assert list(profiles) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.predict(d, profiles).collect()}
    assert all(got[i].lang_pred == k for i, _, k in made if got[i].held_out)
    assert (got[501].lang_pred, got[502].lang_pred, got[502].score) == ("und", "und", 0.0)
    words = "Ab ab, c"
    padded = ["\0ab\0", "\0ab\0", "\0c\0"]
    want = Counter(g for w in padded for n in (1, 2, 3) for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g.strip("\0"))
    assert sorted(np.unique(langid.grams(words), return_counts=True)[1].tolist()) == sorted(want.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(nothing)).collect()} == {"und"}
    assert langid.predict(docs, profiles).count() == len(rows)


def test_wrapped_license_notices(spark):
    r = random.Random(31)
    notices = [(k, x) for k, texts in license_scan.TEMPLATES.items() for x in texts]
    made = []
    for i, (_, notice) in enumerate(notices):
        words = notice.split()
        for k, prefix in enumerate(("", " * ", "# ", "// ")):
            wrapped = "\n".join(prefix + " ".join(words[j : j + 4]).title() for j in range(0, len(words), 4))
            made.append((10 * i + k, f"{prose(20, r)}\n{wrapped}\n{prose(20, r)}"))
        apart = "\n".join(f"{w} {prose(3, r)}" for w in words)
        made.append((10 * i + 9, apart))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    for i, (label, _) in enumerate(notices):
        for k in range(4):
            assert label in got[10 * i + k].labels.split(",") and got[10 * i + k].score == 1.0
        assert got[10 * i + 9].labels == ""


def test_passages(spark, rows, nothing):
    passage, fuzzy = prose(80), prose(120)
    made = [(i, prose(150)) for i in range(20)]
    for i in (4, 9, 13):
        w = made[i][1].split()
        made[i] = (i, " ".join([*w[:30], passage, *w[30:]]))
    made[6] = (6, made[6][1] + " " + fuzzy)
    made[17] = (17, changed(fuzzy, 5) + " " + made[17][1])
    made += [(30, passage), (31, None), (32, ""), (33, "a b"), (34, prose(3)), (None, passage)]
    docs = spark.createDataFrame([(i, t, len(t or ""), 0) for i, t in made], "doc_id long, text string, n_chars long, seed long").repartition(4)
    got = {r.doc_id: r for r in substring.repeated_passages(spark, docs).collect()}
    assert set(got) == {9, 13, 17, 30} and got[17].source_id == 6
    for i in (9, 13):
        assert abs(got[i].start_word - 30) <= 5 and abs(got[i].end_word - 110) <= 5 and got[i].source_id < i
    kept = {r.doc_id: r for r in substring.remove_repeated(spark, docs).collect()}
    assert kept[4].text == made[4][1] and 140 <= len(kept[9].text.split()) <= 160 and kept[9].n_chars == len(kept[9].text)
    assert {0, 31, 32, 33, None} <= set(kept) and list(kept[0].asDict()) == docs.columns
    assert substring.repeated_passages(spark, nothing).count() == 0


def test_exact_passages_of_just_enough_words(spark):
    r = random.Random(11)
    made = []
    for i in range(60):
        passage = prose(49 + i % 6, r)
        made += [(2 * i, f"{prose(40, r)} first {passage} first {prose(30, r)}"), (2 * i + 1, f"{prose(25, r)} second {passage} second {prose(50, r)}")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.start_word, x.end_word, x.source_id, x.source_start) for x in substring.repeated_passages(spark, docs).collect()}
    assert got == {2 * i + 1: (26, 75 + i % 6, 2 * i, 41) for i in range(60) if i % 6}


@pytest.mark.parametrize("percent", [5, 8, 10, 12, 15])
def test_fuzzy_passages(spark, percent):
    r = random.Random(percent)
    made = []
    for i in range(20):
        words = prose(150, r).split()
        made.append((2 * i, " ".join([prose(40, r), *words, prose(40, r)])))
        for k in r.sample(range(150), 150 * percent // 100):
            words[k] = "other"
        made.append((2 * i + 1, " ".join([prose(30, r), *words, prose(60, r)])))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = substring.repeated_passages(spark, docs).collect()
    assert {x.doc_id for x in got} == {2 * i + 1 for i in range(20)} and all(x.source_id == x.doc_id - 1 for x in got)
    assert sum(x.n_words for x in got) >= (0.75 if percent > 12 else 0.85) * 20 * 150


def test_every_copy_of_a_passage(spark):
    r = random.Random(7)
    made = []
    for i in range(10):
        p, line = prose(80, r), prose(60, r)
        part = " ".join(p.split()[:40])
        made += [(4 * i, f"{prose(30, r)} {p} {prose(30, r)} {part} {line}"), (4 * i + 1, f"{prose(50, r)} one {p} one {prose(60, r)} two {p} two {prose(20, r)}")]
        made += [(4 * i + 2, f"{prose(50, r)} three {part} three {prose(60, r)} four {p} four {prose(20, r)}"), (4 * i + 3, f"{line} {prose(60, r)} two {line}")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.start_word, x.end_word) for x in substring.repeated_passages(spark, docs).collect())
    want = []
    for i in range(10):
        want += [(4 * i + 1, 51, 131), (4 * i + 1, 193, 273), (4 * i + 2, 153, 233), (4 * i + 3, 0, 60), (4 * i + 3, 121, 181)]
    assert got == want


def test_chain_against_all_subsets():
    from itertools import combinations

    r = random.Random(3)
    for _ in range(60):
        n = r.randint(2, 7)
        a = sorted((r.randrange(60), r.randrange(60), r.randint(1, 9)) for _ in range(n))
        s, t, k = (np.array(x) for x in zip(*a, strict=True))

        def score(path):
            total = 0.0
            for i, j in zip([None, *path[:-1]], path, strict=True):
                gap = substring.GAP_COST * (s[j] - s[i] - k[i] + t[j] - t[i] - k[i]) if i is not None else 0
                total = k[j] + max(0.0, total - gap)
            return total

        def fits(path):
            return all(s[i] + k[i] <= s[j] and t[i] + k[i] <= t[j] for i, j in zip(path, path[1:], strict=False))

        best = max(score(p) for m in range(1, n + 1) for p in combinations(range(n), m) if fits(p))
        first = substring.chain(s, s + k, t, t + k)[0]
        assert fits(first) and abs(score(first) - best) < 1e-9


def test_words_and_shingles():
    texts = ["A b\tc  d", "", "x", "b c d e f", "é É"]
    for _, part in H.groups(texts):
        h, first, *_ = H.words(part)
        assert np.diff(first).tolist() == [4, 0, 1, 5, 2]
        assert h[1] == h[5] and h[3] == h[7] and len(set(h.tolist())) == 9
        s, text, _ = H.shingles(h, first, 3)
        assert text.tolist() == [0, 0, 2, 3, 3, 3, 4] and s[1] == s[3]
