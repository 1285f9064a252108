"""Operators on documents: defined cases and brute force."""

import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from erlake.llm import decontamination, license_scan, minhash_dedup, sampled_pieces, secrets, substring_dedup, suffix_dedup, toxicity
from erlake.llm.automaton import Automaton, Rule

DOC = "doc_id long, text string, lang string, source string, n_chars long, h1 long, doc long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    shared, long = prose(rng, 120), prose(rng, 3000)
    texts = [None, "", " \n", "one", shared, shared, shared + " tail", "head " + shared, long, long[:6000] + " x " + long[6000:], "a" * 900, "ab " * 400]
    texts += [prose(rng, 60) + "\n" + " ".join(shared.split()[20:90]) + "\té " + prose(rng, 20) for _ in range(12)]
    texts += [" ".join(w if i != j else "zz" for i, w in enumerate(shared.split())) for j in range(3, 100, 20)]
    return list(enumerate(texts)) + [(None, shared), (40, shared), (40, shared)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, 0, 0) for d, t in rows], DOC)


def test_substring_dedup(spark, rows):
    key = lambda x: tuple(str(y) for y in x)
    for bits in (8, 20):  # a sketch of 256 cells is all collisions: still exact
        got = sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(frame(spark, rows), bits=bits).collect()), key=key)
        assert got == sorted(substring_dedup.brute_force(rows), key=key)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_or_a_hash_are_told_apart(spark):
    import itertools

    # two long texts with one 32-bit hash
    words = [f"w{i}" for i in range(70)]
    texts = spark.range(400_000).select(F.concat(F.lit(" ".join(words) + " "), F.col("id")).alias("t")).withColumn("h", F.hash("t"))
    pair = texts.groupBy("h").agg(F.collect_list("t").alias("t")).where("size(t) > 1").first().t
    a, b = pair[0], pair[1]
    other = " ".join(f"z{i}" for i in range(120))
    key = lambda x: tuple(str(y) for y in x)
    given = [(1, a), (7, a), (7, b), (None, a), (None, b), (3, other), (None, other), ((1 << 63) - 2, other)]
    for rows in (given, list(itertools.islice(reversed(given), 6))):
        got = sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(frame(spark, rows), bits=16).collect()), key=key)
        assert got == sorted(substring_dedup.brute_force(rows), key=key)
        got = sorted((tuple(r)[:5] for r in suffix_dedup.suffix_dedup(frame(spark, rows), bits=16).collect()), key=key)
        assert got == sorted(suffix_dedup.brute_force(rows), key=key)


@pytest.mark.parametrize("hot", [0, 256])
def test_suffix_dedup(spark, rows, hot):
    key = lambda x: tuple(str(y) for y in x)
    got = sorted((tuple(r)[:5] for r in suffix_dedup.suffix_dedup(frame(spark, rows), bits=16, hot=hot).collect()), key=key)
    assert got == sorted(suffix_dedup.brute_force(rows), key=key)
    assert suffix_dedup.suffix_dedup(frame(spark, []), bits=10).count() == 0


def test_minhash_dedup(spark, rows):
    some = [r for r in rows if r[0] is not None]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.classes(frame(spark, rows)).collect()}
    want = minhash_dedup.brute_force(some)
    assert got.pop(None) == (None, True)
    assert got == {d: (x, x == d) for d, x in want.items()}
    assert minhash_dedup.classes(frame(spark, [])).count() == 0
    kept = minhash_dedup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {None, *want.values()}


def test_minhash_dedup_compares_what_leaders_leave(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for d in range(90):
        words = list(base)
        for i in rng.integers(0, 400, rng.integers(1, 6)):
            words[i] = f"x{rng.integers(0, 40)}"
        texts.append((d, " ".join(words)))
    want = minhash_dedup.brute_force(texts)
    seen = []
    real = minhash_dedup.left_over

    def watched(*args):
        pairs = real(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_dedup, "left_over", watched)
    for rounds in (1, 2):
        got = {r.doc_id: r.class_id for r in minhash_dedup.classes(frame(spark, texts), rounds=rounds).collect()}
        assert got == want and 1 < len(set(want.values())) < 90
    assert seen[0] > 0


def test_minhash_left_over_keeps_every_pair_that_links(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(60)]
    texts = []
    for d in range(70):
        words = list(base[: rng.integers(45, 61)])
        for i in rng.integers(0, len(words), rng.integers(0, 5)):
            words[i] = f"y{rng.integers(0, 6)}" if rng.random() < 0.7 else words[i] + " " + words[i]
        texts.append((d, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc long, text string")
    idf = minhash_dedup.idf_cells(docs)
    sets = list(minhash_dedup.shingles(pa.array([t for _, t in texts])))
    sim = {(a, b): minhash_dedup.weighted_jaccard(sets[a], sets[b], idf) for a in range(70) for b in range(a + 1, 70)}
    for leader in (0, 7):  # one bucket of all, each a class of its own but for those that link with the leader
        members = docs.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), F.col("doc").alias("node"), F.lit(leader).cast("long").alias("leader"))
        close = [(d, min([leader, *(x for x in range(70) if sim.get((min(x, leader), max(x, leader)), 0) >= 0.8)])) for d in range(70) if d == leader or sim[min(d, leader), max(d, leader)] >= 0.8]
        root = dict(close)
        none = spark.createDataFrame([], "a long, b long, sim double")
        got = {tuple(r) for r in minhash_dedup.left_over(members, docs, spark.createDataFrame(close, "id long, root long"), none, spark.sparkContext.broadcast(idf), 0.8).collect()}
        links = {(a, b) for (a, b), x in sim.items() if x >= 0.8 and root.get(a, a) != root.get(b, b)}
        assert links and links <= got and len(got) < len(sim) / 2


def test_consistent_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(5)
    same = sim = 0.0
    for _ in range(150):
        names = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        wa, wb = rng.random(60) + 0.1, rng.random(60) + 0.1
        same += (minhash_dedup.samples(names, wa) == minhash_dedup.samples(names, wb)).mean()
        sim += np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert same / 150 == pytest.approx(sim / 150, abs=0.03)


def test_decontamination(spark):
    item = "In May Tom has 12 apples and buys 30 kg more from Anna. How many apples does Tom have now in total?"
    docs = [(1, "so: " + item + " end"), (2, "In May Kim has 7 apples and buys 99 kg more from Lee. How many apples does Kim have now in total?"), (3, "nothing here"), (4, None), (5, ""), (None, item), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "In May Kim has 7 apples and buys 7 kg more from Lee. How many apples does Bob have now in total?")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short item"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(1, 1): False, (2, 1): True}
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    assert decontamination.contaminated(frame(spark, docs), bench.where("false")).count() == 0
    assert sorted(str(r.doc_id) for r in decontamination.drop_contaminated(frame(spark, docs), bench).collect()) == ["3", "4", "5", "6", "7", "None"]


def test_decontamination_finds_short_and_number_heavy_items(spark):
    heavy = "Add the numbers of this list: 12 7 93 55 4 81 23 64 19 38 72 41 6 90 27 33"
    items = [(1, "What is 17 plus 25?"), (2, "What is the capital of France?"), (3, heavy), (4, "Tom pays 30 kg")]
    docs = [(1, "Question: What is 17 plus 25? Say it."), (2, "He asked: What is the capital of France? Paris"), (3, "so " + heavy), (4, "What is 18 plus 25?"), (5, "what is the capital of Spain?"), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"), (7, "and what is the capital of france")]
    docs += [(8, "so Add the numbers of this list: " + " ".join(str(100 + i) for i in range(16)))]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (7, 2), (8, 3)}


def test_decontamination_knows_names_that_open_sentences(spark):
    item = "Tom has 12 apples. Anna has 30 more apples. Tom gives Anna 5 apples. How many apples does Tom have now?"
    other = item.replace("Tom", "Kim").replace("Anna", "Lee").replace("12", "7").replace("30", "99").replace("5", "3")
    docs = [(1, "x " + item), (2, other), (3, other.replace("How", "So how")), (4, "The sea is wide. We saw it from the shore and had 12 apples.")]
    got = {r.doc_id: r.reparameterised for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_decontamination_drops_only_windows_with_the_conflict(spark):
    item = "In May Tom has 12 apples and buys 30 kg more from Anna. How many apples does Tom have now in total?"
    docs = [(1, item.replace("does Tom", "does Bob")), (2, item.replace("12", "7").replace("30", "7")), (3, item.replace("Tom has 12", "Kim has 7").replace("buys 30", "buys 7").replace("Tom have", "Bob have"))]
    got = {r.doc_id: (r.n_windows, r.n_matched) for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (15, 10), 2: (15, 15)}


def test_automaton_is_minimal_and_right():
    a = Automaton([Rule("(ab|cb)+d?")], search=False)
    assert a.longest(a.of[np.frombuffer(b"abcbdx", np.uint8)].tobytes(), 0, 6) == 5
    assert Automaton([Rule("a|b|c")], search=False).size == 3
    with pytest.raises(ValueError):
        Rule("(a")


def test_secrets(spark, rows):
    import hashlib

    rng = random.Random(2)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "a", "F", "0", "password", "API_KEY", "AKIA", "1234567890abcdef", "ABCDEFGH12", "é", "\n", ",", "deadbeef", "passwd", "-"]
    texts = list(enumerate("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800))) + rows
    digest = lambda x: hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in x if s.kind in secrets.BASE).encode()).hexdigest()
    got = [(r.doc_id, digest(r.spans)) for r in secrets.find_secrets(frame(spark, texts)).collect()]
    assert sorted(map(str, got)) == sorted(str((x[0], x[4])) for x in secrets.brute_force(texts))
    long = [(1, "token=abcdef1 " * 80_000), (2, "a" * 1_200_000)]  # more than a step, without any byte that ends all matches
    got = [(r.doc_id, digest(r.spans)) for r in secrets.find_secrets(frame(spark, long)).collect()]
    assert sorted(got) == sorted((x[0], x[4]) for x in secrets.brute_force(long))
    assert secrets.find_secrets(frame(spark, [])).count() == 0 == secrets.redact(frame(spark, [])).count()
    out = secrets.redact(frame(spark, [(1, 'é token = "abcdef123" x'), (2, None)]))
    assert [r.text for r in out.orderBy("doc_id").collect()] == ['é <assign>" x', None]


def test_toxicity_search_is_exact_and_scores(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, 30) + (" idiot moron clown" if i % 3 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (None, "idiot moron")]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(400)] + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame(spark, docs), labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, docs), index).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(400)) and got[900] < 0.5 and got[901] < 0.5 and got[None] >= 0.5
    dense = np.zeros((len(index.label), len(index.terms)))
    for term in range(len(index.terms)):
        a, b = index.cut[term, 0], index.cut[term, -1]
        dense[index.example[a:b], term] = index.weight[a:b]
    for names, n in toxicity.term_counts(pa.array([t for _, t in docs[:60]])):
        t, w = index.vector(names, n)
        want = np.sort(dense[:, t] @ w)[::-1][: toxicity.K]
        assert index.search(t, w)[1] == pytest.approx(want[want > 0])
    empty = toxicity.fit(frame(spark, []), labels.where("false"))
    assert toxicity.score_toxicity(frame(spark, docs[:2]), empty).count() == 2
    assert toxicity.drop_toxic(frame(spark, docs), labels).columns == frame(spark, docs).columns


def test_toxicity_scores_no_document_by_its_own_label(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, 25) + (" idiot moron" if i % 3 == 0 else "")) for i in range(300)]
    right = [(i, int(i % 3 == 0)) for i in range(300)]
    flipped = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 5)
    scores = []
    for y in (0, 1):
        labels = spark.createDataFrame([(i, 0, y if i == flipped else t) for i, t in right], "doc_id long, quality int, toxic int")
        rows = toxicity.score_toxicity(frame(spark, docs), toxicity.fit(frame(spark, docs), labels)).collect()
        assert all(e.doc_id != r.doc_id for r in rows for e in r.evidence)
        scores.append({r.doc_id: r.score for r in rows})
    # the others' calibration moves a little with one label, the document's own side of the threshold doesn't
    assert (scores[0][flipped] >= 0.5) == (scores[1][flipped] >= 0.5) == (flipped % 3 == 0)
    assert toxicity.score_toxicity(frame(spark, []), toxicity.fit(frame(spark, docs), labels)).count() == 0


def test_toxicity_keeps_every_word_of_the_examples(spark):
    rng = random.Random(8)
    # each toxic word stands in four examples alone, under any cut by frequency or chi-squared
    docs = [(i, prose(rng, 12) + (f" slur{i // 8}" * 6 if i % 2 else "")) for i in range(320)] + [(1000 + i, prose(rng, 12) + f" slur{i}" * 6) for i in range(40)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(320)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame(spark, docs), labels)
    words = {i: dict(zip(*(x.tolist() for x in d))) for (i, _), d in zip(docs, toxicity.term_counts(pa.array([t for _, t in docs])))}
    assert set(index.terms.tolist()) == {w for i in index.ids for w in words[int(i)]}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    assert index.idf == pytest.approx([np.log((1 + len(docs)) / (1 + df[w])) + 1 for w in index.terms.tolist()])
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, docs), index).collect()}
    known = {int(i) // 8 for i, y in zip(index.ids, index.label) if y}
    assert sum(got[1000 + i] >= 0.5 for i in known) > 0.9 * len(known)


def test_license_scan(spark):
    mit, bsd = dict(license_scan.KNOWN[:1])["MIT"], next(t for k, t in license_scan.KNOWN if k == "BSD-3-Clause")
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace("free of charge", "free\u00a0of charge")
    marked = "\n".join("# " + x for x in ("Copyright 2020 Someone\n(c) 2021 Another\n" + mit).split("\n"))
    docs = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (2, "MIT"), (3, None), (4, "Released under the MIT Licence."), (5, curly), (6, marked), (7, bsd), (8, ""), (None, mit), (None, mit)]
    docs += [(9, "(c) You must keep the notices."), (10, "(c) You may drop all notices.")]
    rows = license_scan.license_scan(frame(spark, docs)).collect()
    got = {r.doc_id: r.license for r in rows}
    assert got == {1: "MIT", 2: None, 3: None, 4: "MIT", 5: "MIT", 6: "MIT", 7: "BSD-3-Clause", 8: None, 9: None, 10: None, None: "MIT"} and len(rows) == len(docs)
    digest = {r.doc_id: r.digest for r in rows}
    assert digest[9] != digest[10] and digest[3] == digest[8]
    assert license_scan.license_scan(frame(spark, [])).count() == 0
    own = spark.createDataFrame([("own", "My own licence text"), ("own", None), (None, "x")], "license string, text string")
    got = {r.doc_id: r.license for r in license_scan.license_scan(frame(spark, [(1, "MY OWN license text!"), (2, "x")]), own).collect()}
    assert got == {1: "own", 2: None}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="needs the published texts")
def test_license_scan_knows_the_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    docs = [(k, Path(f"/usr/share/common-licenses/{f}").read_text()) for k, f in enumerate(names)]
    assert {r.doc_id: r.license for r in license_scan.license_scan(frame(spark, docs)).collect()} == dict(enumerate(names.values()))


def test_sampled_pieces(spark, rows):
    docs = [*rows, (70, "a▁ b\n\n 𝔘é  x "), (71, "   ")]
    got = sampled_pieces.encode(frame(spark, docs), k=3).collect()
    texts = {}
    for d, t in docs:
        texts.setdefault(d, t or "")
    for r in got:
        assert 1 <= len(r.samples) <= 3 and len({tuple(s.ids) for s in r.samples}) == len(r.samples)
        assert all(sampled_pieces.decode(s.ids) == texts[r.doc_id] for s in r.samples)
        assert all(0 <= s.inclusion <= 1 for s in r.samples)
    again = {r.doc_id: r for r in sampled_pieces.encode(frame(spark, docs).repartition(3), k=3).collect()}
    for r in got:
        for a, b in zip(r.samples, again[r.doc_id].samples, strict=True):
            assert a.ids == b.ids and a.logp == pytest.approx(b.logp) and a.inclusion == pytest.approx(b.inclusion, abs=1e-6)


def test_sampling_follows_the_distribution():
    p = sampled_pieces.pieces(sampled_pieces.MODEL, 0.2)
    n = 6000
    got = sampled_pieces.sample_texts(np.arange(n), ["there"] * n, p, 2, 9)
    prob = {tuple(s[0]): np.exp(s[1]) for x in got for s in x}
    first, second = {}, {}
    for a, b in ((tuple(x[0][0]), tuple(x[1][0])) for x in got):
        first[a] = first.get(a, 0) + 1
        second[b] = second.get(b, 0) + 1
    assert sum(prob.values()) == pytest.approx(1, abs=0.02)
    for k, v in prob.items():
        assert first.get(k, 0) / n == pytest.approx(v, abs=0.03)
        want = sum(prob[j] * v / (1 - prob[j]) for j in prob if j != k)  # successive sampling without replacement
        assert second.get(k, 0) / n == pytest.approx(want, abs=0.03)


def test_sampling_of_several_chunks_and_inclusion():
    p, n, k = sampled_pieces.pieces(sampled_pieces.MODEL, 0.15), 8000, 2
    got = sampled_pieces.sample_texts(np.arange(n), ["to it"] * n, p, k, 5)
    prob = {tuple(s[0]): np.exp(s[1]) for x in got for s in x}
    assert len(prob) >= 9 and sum(prob.values()) == pytest.approx(1, abs=0.02)
    first, both, weighed = {}, {}, {}
    for x in got:
        ids = [tuple(s[0]) for s in x]
        first[ids[0]] = first.get(ids[0], 0) + 1 / n
        both[tuple(ids)] = both.get(tuple(ids), 0) + 1 / n
        for s in x:
            weighed.setdefault(tuple(s[0]), []).append(1 / s[2])
    for a, v in prob.items():
        assert first.get(a, 0) == pytest.approx(v, abs=0.025)
        # a segmentation's indicator over its inclusion score has mean 1
        x = np.array(weighed[a] + [0.0] * (n - len(weighed[a])))
        assert abs(x.mean() - 1) < 5 * x.std() / np.sqrt(n) + 0.01
        for z, w in prob.items():
            if a != z:
                assert both.get((a, z), 0) == pytest.approx(v * w / (1 - v), abs=0.02)


def test_sampled_pieces_of_empty_tables_and_long_texts(spark):
    assert sampled_pieces.encode(frame(spark, [])).count() == 0
    text = "the long text goes on, " * 60_000
    row = sampled_pieces.encode(frame(spark, [(1, text)]), k=1).first()
    assert sampled_pieces.decode(row.samples[0].ids) == text


def test_lattices_of_a_chunk_are_built_once_and_change_nothing(monkeypatch):
    p = sampled_pieces.pieces(sampled_pieces.MODEL, 0.3)
    rng = random.Random(4)
    steps = [[prose(rng, 40), "it is the same, é\U0001d518▁ \n\n to all ", "", "x\n \n  y" + "z" * 70, prose(rng, 30)] for _ in range(5)]
    plain = lambda x: [[(s[0].tolist(), s[1], s[2]) for s in y] for y in x]
    sample = lambda texts, lattices=None: plain(sampled_pieces.sample_texts(np.arange(5), texts, p, 3, 1, lattices))
    alone = [sample(x) for x in steps]
    held = sampled_pieces.Lattices(p)
    assert [sample(x, held) for x in steps] == alone
    n = held.chunks
    assert n == len({tuple(x) for x in np.split(held.code[: held.nodes], np.sort(held.base[:n])[1:])})
    assert [sample(x, held) for x in steps] == alone and held.chunks == n
    # chunks that several steps had stay when the others are forgotten
    held.forget()
    assert held.chunks == n and [sample(x, held) for x in steps] == alone
    monkeypatch.setattr(sampled_pieces, "HELD", 600)
    held = sampled_pieces.Lattices(p)
    assert [sample(x, held) for x in steps * 2] == alone * 2 and held.chunks < n
    # different chunks with one name
    monkeypatch.setattr(sampled_pieces.Lattices, "_names", staticmethod(lambda code, cut: np.diff(cut).astype(np.uint64)))
    held = sampled_pieces.Lattices(p)
    assert [sample(x, held) for x in steps] == alone


def test_chunks_and_bytes_as_by_regex():
    rng = random.Random(5)
    texts = ["".join(rng.choice("▁▁\n\nabé") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.cumsum([0, *map(len, texts)])
    want = [a + m.start() for a, t in zip(at, texts) for m in re.finditer("\n+|▁*[^▁\n]+|▁+", t)]
    assert sampled_pieces._cuts(code, at).tolist() == [*want, len(code)]


def test_second_segmentations_of_one_long_chunk_take_linear_time():
    p, took = sampled_pieces.pieces(sampled_pieces.MODEL, 1.0), []
    for n in (2_000, 32_000):
        begun = time.process_time()
        a, b = sampled_pieces.sample_texts(np.array([5]), ["ab" * n], p, 2, 17)[0]
        took.append(time.process_time() - begun)
        assert a[0].tolist() != b[0].tolist() and sampled_pieces.decode(a[0]) == sampled_pieces.decode(b[0]) == "ab" * n
    assert took[1] < 45 * took[0]
