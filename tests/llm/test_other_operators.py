"""Conversations, embeddings and the pipeline."""

import itertools
import random
import re

import numpy as np
import regex

from erlake.llm import common, embedding_dedup, quotes


def test_quote_linking(spark):
    first = "Hello there, this is the plan.\nSecond line of it."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "> Hello there, this is the PLAN\n> Second line of it.\nI agree."),
        (1, 2, "user", "> > Hello there, this is the plan.\n> I agree.\nThanks!"), (1, 3, "assistant", "An aside."), (1, 4, "user", "> nobody said this\nok"),
        (1, 4, "user", "> nobody said this\nok"), (2, 0, "user", None), (None, 1, "user", "> x"), (2, None, "user", first),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, level int")
    out = quotes.reply_order(df)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.text, r.max_level) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, 0][:3] == (None, 0, 0) and got[1, 1] == (0, 0, 1, "I agree.", 1) and got[1, 2] == (1, 0, 2, "Thanks!", 2)
    assert got[1, 3][:3] == (None, 3, 0) and got[1, 4] == (None, 4, 0, "ok", 1) and got[2, 0][3] == ""
    assert quotes.reply_order(df.where("false")).count() == 0


def linked_by_brute_force(rows):
    """(conv, turn) to (parent, n_linked): pieces of text compared in memory."""
    normal = lambda x: " ".join(regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).split())

    def pieces(text):
        lines = [(m[1].count(">") if (m := re.match(r"[ \t]*(>[> \t]*)", x)) else 0, re.sub(r"^[ \t]*(>[> \t]*)", "", x)) for x in (text or "").split("\n")]
        out = list(lines)
        for level, run in itertools.groupby(lines, key=lambda x: x[0]):
            body = "\n".join(x for _, x in run)
            out += [(level, body), *((level, x) for x in re.split(r"\n[ \t\r]*\n", body))]
        return [(k, normal(x)) for k, x in out] + [(0, normal("\n".join(x for k, x in lines if k == 0)))]

    cut = {(c, n): {x for x in pieces(text) if x[1]} for c, n, _, text in rows if c is not None and n is not None}
    out = {}
    for (c, n), mine in cut.items():
        hits = {}
        for level, x in mine:
            origin = [m for (d, m), theirs in cut.items() if d == c and m < n and (0, x) in theirs]
            if level and origin:
                hits[level, x] = max(origin)
        least = min((level for level, _ in hits), default=0)
        weight = {}
        for (level, x), m in hits.items():
            if level == least:
                weight[m] = weight.get(m, 0) + len(x)
        out[c, n] = (max(weight, key=lambda m: (weight[m], m)) if weight else None, len(hits))
    return out


def test_quote_linking_by_brute_force(spark):
    rng = random.Random(6)
    say = ["Hello there, all.", "The plan holds", "We meet at nine", "", "Bring the maps.", "ok", "no", "Äpfel und Birnen", "see you"]
    rows = []
    for c in range(12):
        texts = []
        for n in range(9):
            lines = [rng.choice(say) for _ in range(rng.randint(1, 4))]
            if texts and rng.random() < 0.8:
                old = rng.choice(texts)
                if rng.random() < 0.4:
                    old = " ".join(old.replace("> ", "").split())  # wrapped anew
                lines = [f"> {x}" for x in old.split("\n")[: rng.randint(1, 5)]] + lines
                if rng.random() < 0.3:
                    lines += [f">> {rng.choice(say)}"]
            texts.append("\n".join(lines))
            rows.append((c, n, "user", texts[-1]))
    rows.append((99, 0, "user", "One paragraph of\nmy message.\n\nAnother one."))
    rows.append((99, 1, "user", "> One paragraph\n> of my message.\nYes."))  # wrapped anew, one paragraph of several
    want = linked_by_brute_force(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in quotes.reply_order(df).collect()}
    assert got == want and want[99, 1] == (0, 1) and sum(p is not None for p, _ in want.values()) > 30


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.15, 0.3])
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, rows[0][1], None), (207, [2 * x for x in rows[0][1]], 0), (208, [], 0), (209, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    good = [r for r in rows if r[1] and None not in r[1] and any(r[1]) and not np.isnan(r[1]).any() and r[2] is not None]
    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    assert got == {v: (links[v], find(v), find(v) == v) for v in root}
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark):
    """Each stage against a plain version over its own input."""
    import corpus_pipeline as p
    from erlake.llm import decontamination, minhash_dedup, sampled_pieces, secrets, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels, benchmark = docs.columns, spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for i, (name, stage) in enumerate(p.STAGES):
        rows = docs.collect()
        out = common.stored(stage(spark, docs, sf))
        got = out.collect()
        if i < 4:
            assert out.columns == columns
        kept = {r.doc_id for r in got}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
            assert kept == {d for d, x in scores.items() if x < 0.5} and len(kept) < len(rows)
        elif name == "minhash_near_dedup":
            assert kept == set(minhash_dedup.brute_force([(r.doc_id, r.text) for r in rows]).values()) and len(kept) < len(rows)
        elif name == "benchmark_decontamination":
            items = [" ".join((r.text or "").lower().split()) for r in benchmark.collect()]
            verbatim = {r.doc_id for r in rows if any(x and x in " ".join((r.text or "").lower().split()) for x in items)}
            found = {r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()}
            assert verbatim <= found and kept == {r.doc_id for r in rows} - found
        elif name == "secret_scan":
            assert kept == {r.doc_id for r in rows}
            left = secrets.brute_force([(r.doc_id, r.text) for r in got])
            assert all(n_access == n_hex == 0 for _, _, n_access, n_hex, _ in left) and all(r.n_chars == len(r.text) for r in got if r.text is not None)
            clean = {d for d, *n, _ in secrets.brute_force([(r.doc_id, r.text) for r in rows]) if not any(n)}
            before = {r.doc_id: r.text for r in rows}
            assert sum(r.text == before[r.doc_id] for r in got) >= 0.95 * len(clean) > 0
        else:
            texts = {r.doc_id: r.text or "" for r in rows}
            assert kept == set(texts) and all(sampled_pieces.decode(s.ids) == texts[r.doc_id] for r in got for s in r.samples)
        docs = out


def test_pipeline_stages_take_nulls_empty_tables_and_other_columns(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", None, 5), (2, "", None, "s", 0), (3, "a plain text of words", None, None, 21), (3, "a plain text of words", None, None, 21), (None, "token=abcdefgh", None, None, 14)]
    docs = spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r))[f] for f in schema.fieldNames()) for r in odd], schema)
    more = docs.selectExpr("*", "1 AS node", "'x' AS h1", "2L AS doc", "'y' AS _gone", "3 AS id", "true AS kept", "'z' AS spans")
    for i, (name, stage) in enumerate(p.STAGES):
        for df in (docs, more):
            out = stage(spark, df, sf)
            assert out.count() == len(odd), name  # rows of one doc_id are one document, of which both stay
            assert i == 4 or out.columns == df.columns
            assert stage(spark, df.where("false"), sf).count() == 0
        if name == "secret_scan":
            assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} >= {(1, None, 5), (None, "<assign>", 8)}
