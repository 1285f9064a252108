"""Evaluations, profiles, sinks and settings: defined cases and brute force."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from erlake import catalog, reports
from erlake.functions import config
from erlake.functions import text as t
from erlake.operators import blocking as b
from erlake.operators import profile as pr
from erlake.operators import retrieval as r
from erlake.operators import tfidf
from erlake.sources import index, records, sinks

SF = "/root/testdata/sf0.001"


def naive_ratio(x, y):
    """Indel similarity from the longest common subsequence by the textbook table."""
    if not x and not y:
        return 1.0
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, c in enumerate(y):
            new.append(row[j] + 1 if a == c else max(new[-1], row[j + 1]))
        row = new
    return 2 * row[-1] / (len(x) + len(y))


def naive_token_set(x, y):
    """The best ratio among the shared words, and the shared words with either side's others."""
    a, c = set(x.split()), set(y.split())
    if not a or not c:
        return 0.0
    if a & c and (a <= c or c <= a):
        return 1.0
    both = " ".join(sorted(a & c))
    one, two = ((both + " " + " ".join(sorted(d))).strip() for d in (a - c, c - a))
    return max([naive_ratio(one, two)] + ([naive_ratio(both, one), naive_ratio(both, two)] if both else []))


@pytest.fixture(scope="module")
def scored(spark):
    keys = catalog._keys(spark, SF)
    pairs = b.route_pairs(keys, 30, ("country_state_name", "country_city_name", "country_numeric")).select("s1", "candidate").distinct()
    return b.ranked(b.paired(pairs, keys)).cache()


def test_rank_score_by_brute_force(scored):
    rows = scored.collect()
    assert len(rows) > 200
    for x in rows:
        name, address = (100 * max(f(x.a[k], x.b[k]) for f in (naive_ratio, naive_token_set)) for k in ("name_n", "addr_n"))
        bonus = sum(w for k, w in (("postal", 18), ("state", 8), ("city", 5)) if x.a[k] and x.a[k] == x.b[k])
        assert x.score == pytest.approx(0.58 * name + 0.27 * address + bonus) and x.second == pytest.approx(name + address)


def test_quotas_and_hard_negatives_by_brute_force(scored):
    of, truth = {}, catalog._truth(catalog._keys(scored.sparkSession, SF))
    links = {tuple(x) for x in truth.collect()}
    for x in scored.select("s1", "candidate", "score", "second").collect():
        of.setdefault(x.s1, []).append(x)
    want, negatives = set(), set()
    for limit in (1, 2, 3, 4):
        for s1, rows in of.items():
            rows = sorted(rows, key=lambda x: (-x.score, -x.second, x.candidate))
            if len(rows) <= limit:
                keep = rows
            else:
                keep = [x for s in ("S2", "S3") for x in [y for y in rows if y.candidate.startswith(s)][: limit // 2]]
                keep += [x for x in rows if x not in keep][: limit - len(keep)]
            want |= {(limit, s1, x.candidate) for x in keep}
    got = {(x.cap, x.s1, x.candidate) for x in b.quota_caps(scored, [1, 2, 3, 4]).collect()}
    assert got == want and max(map(len, of.values())) > 4
    assert {(x.s1, x.candidate) for x in b.quota_cap(scored, 3).collect()} == {(s, c) for cap, s, c in want if cap == 3}
    for s1, rows in of.items():
        for s in ("S2", "S3"):
            wrong = [x for x in rows if x.candidate.startswith(s) and (s1, x.candidate) not in links]
            wrong.sort(key=lambda x: x.candidate, reverse=True)
            wrong.sort(key=lambda x: (-x.score, -x.second))
            negatives |= {(s1, x.candidate) for x in wrong[:6]}
    assert {(x.s1, x.candidate) for x in b.hard_negatives(scored, truth).collect()} == negatives


def test_top_k_checks_and_empty_rates(spark):
    anchors = spark.createDataFrame([("a",), ("c",)], "s1 string")
    found = spark.createDataFrame([("a", "S2-1", 1), ("a", "S3-1", 2)], "s1 string, candidate string, rank int")
    none = spark.createDataFrame([], "s1 string, candidate string")
    corpus = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    r.check_candidates(anchors, found)
    for wrong in (found.union(found), found.withColumn("s1", F.lit("z"))):
        with pytest.raises(ValueError):
            r.check_candidates(anchors, wrong)
    with pytest.raises(ValueError):
        r.check_candidates(anchors.where("false"), found)
    x = r.evaluate_top_k(anchors, none, found, corpus, [1]).first()
    assert x.candidate_recall is None and x.non_singleton_full_hit_rate is None and x.full_hit_rate == 1 and x.avg_candidates == 0.5
    assert b.union_best([]).count() == 0
    with pytest.raises(ValueError):
        r.joined_once(found, found, "s1")
    with pytest.raises(ValueError):
        r.restricted(none, anchors)
    with pytest.raises(ValueError):
        b.quota_caps(found, [])


def test_sweep_prefers_the_smaller_threshold(spark):
    anchors, truth = spark.createDataFrame([("a",)], "s1 string"), spark.createDataFrame([("a", "x")], "s1 string, candidate string")
    capped = spark.createDataFrame([("a", "x", 1, 0.993), ("a", "y", 1, 0.31)], "s1 string, candidate string, cap int, p double")
    assert {(x.metric, x.score, x.threshold) for x in r.wide_sweep(anchors, truth, capped).collect()} == {("f1", 1.0, 0.35), ("f05", 1.0, 0.35)}


def test_row_cosines_and_word_grams(spark):
    texts = spark.createDataFrame([("1", "red big house"), ("2", "red big"), ("3", "big house"), ("4", ""), ("5", None)], "id string, text string")
    v = tfidf.vectors(texts, texts, True, 1, 2, 2, None, True)
    assert {x.g for x in v.collect()} == {"red", "big", "house", "red big", "big house"}
    pairs = spark.createDataFrame([("1", "1"), ("1", "4"), ("2", "3")], "s1 string, candidate string")
    got = {(x.s1, x.candidate): x.cosine for x in tfidf.row_cosines(pairs, v, v).collect()}
    assert got["1", "1"] == pytest.approx(1) and got["1", "4"] == 0 and 0 < got["2", "3"] < 1
    assert tfidf.vectors(texts, texts, True, 1, 2, 2, 1).select("g").distinct().count() == 1


def test_sketches_and_samples(spark):
    df = spark.range(20_000).select(F.concat(F.lit("S1-"), F.col("id") % 9000).alias("entity_id"), F.lit("S1").alias("source"))
    assert pr.distinct_estimates(df, ["entity_id"]).first().n_entity_id == pytest.approx(9000, rel=0.05)
    some = df.where(t.hash_sample_64(F.col("entity_id"), 10)).distinct().count()
    assert 700 < some < 1100 and some == df.repartition(7).where(t.hash_sample_64(F.col("entity_id"), 10)).distinct().count()
    one = [x.entity_id for x in pr.drawn(df.distinct(), "entity_id", 9, 1).collect()]
    assert one == [x.entity_id for x in pr.drawn(df.distinct().repartition(5), "entity_id", 9, 1).collect()] != [x.entity_id for x in pr.drawn(df.distinct(), "entity_id", 9, 2).collect()]


def test_result_files(spark, tmp_path):
    anchors = spark.createDataFrame([(i, f"S1-{9 - i}") for i in range(9)], "position long, s1 string")
    found = spark.createDataFrame([("S1-3", "S2-2"), ("S1-3", "S2-10"), ("S1-5", "S3-1")], "s1 string, candidate string")
    lists = sinks.aligned_lists(anchors, found, found.limit(1))
    m, c = str(tmp_path / "m"), str(tmp_path / "c")
    sinks.write_submission(lists, m, c)
    back = sinks.read_submission(spark, m, c).collect()
    assert {x.source1_entity_id: (x.matched_entity_ids, x.candidate_entity_ids) for x in back}["S1-3"] == ("S2-2", "S2-10,S2-2") and len(back) == 9
    lines = [x for p in sorted((tmp_path / "m").glob("part*")) for x in p.read_text().splitlines() if not x.startswith("source1")]
    assert [x.split("\t")[0] for x in lines] == [f"S1-{9 - i}" for i in range(9)]
    sinks.write_submission(lists.limit(1), m, str(tmp_path / "other"))
    for a, z in ((m, c), (c, m)):
        with pytest.raises(ValueError):
            sinks.read_submission(spark, a, z)
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "position long, id string")
    assert sinks.zipped(ids, ids).count() == 2
    with pytest.raises(ValueError):
        sinks.zipped(ids, ids.limit(1))
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "position long, source1_entity_id string")
    kept, n, again = sinks.repaired(rows)
    assert (kept.count(), n, again) == (2, 2, "a") and sinks.repaired(rows.limit(2))[1:] == (2, None)
    sinks.write_metrics(rows, str(tmp_path / "x.csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x.csv")).count() == 4
    sinks.write_candidates(found, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_index_is_built_once_for_an_input(spark, tmp_path):
    data = str(tmp_path / "d")
    spark.range(3).write.parquet(data)
    files = spark.read.parquet(data).inputFiles()
    signature, built = index.manifest(spark, files, ("functions/text.py",), {"k": 1}), []

    def build():
        built.append(1)
        return spark.range(5)

    assert [index.resumed(spark, "t", signature, build).count() for _ in range(2)] == [5, 5] and len(built) == 1
    assert index.resumed(spark, "t", signature | {"config": {"k": 2}}, build).count() == 5 and len(built) == 2
    sinks.write_manifest(spark, signature, str(tmp_path / "manifest"))
    assert sinks.read_manifest(spark, str(tmp_path / "manifest")) == signature


def test_settings():
    assert config.experiment_name("a-B_9") == "a-B_9"
    for wrong in ("", "a b", None, "a/b"):
        with pytest.raises(ValueError):
            config.experiment_name(wrong)
    assert config.run_id(datetime(2026, 1, 2, 3, 4, 5, 6, timezone.utc)) == "20260102T030405.000006Z"
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    assert config.with_overrides(base, {"a": {"y": 5}, "c": {"z": 1}}) == {"a": {"x": 1, "y": 5}, "b": 3, "c": {"z": 1}} and base["a"]["y"] == 2
    with config.PeakMemory() as m:
        x = bytearray(50_000_000)
    assert m.peak > 50_000_000 and len(x)


def test_experiment_normaliser_options(spark):
    df = spark.createDataFrame([("℡  A&B, Straße",), ("plain  Text!",), (None,)], "x string")
    run = lambda **o: [x.n for x in t.experiment(df, "x", "n", **o).collect()]
    assert run() == ["tel a b strasse", "plain text", ""]
    assert run(casefold=False) == ["TEL A B Straße", "plain Text", ""]
    assert run(unicode_nfkc=False)[0] == "℡ a b strasse".replace("℡", " ").strip()
    assert run(punctuation_to_space=False)[0] == "tel a&b, strasse"
    assert run(casefold=False, unicode_nfkc=False, collapse_whitespace=False)[1] == "plain  Text "
    with pytest.raises(ValueError):
        run(stemming=True)


def test_head_and_malformed_rows(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tUS\nS1-2\t\t\t\n")
    columns, rows = records.head(spark, str(tmp_path / "r.tsv"), 1)
    assert columns[0] == "entity_id" and rows.count() == 1
    ids = spark.createDataFrame([("S1-1",), ("S1-1",), ("S2-x",), ("S3-4",)], "entity_id string")
    assert {tuple(x) for x in pr.malformed(ids).collect()} == {("S1-1", 2, False), ("S2-x", 1, True)}


def test_every_report_has_sql_or_a_test_here():
    assert set(reports.queries()) - set(catalog.oracle_sql()) == {"distinct_sketches", "hash_sample_64"}


def test_similarities_by_brute_force():
    from erlake.functions import kernels as k

    rng = random.Random(5)
    for _ in range(400):
        x, y = (" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4))) for _ in range(2))
        assert k.indel(x, y) == pytest.approx(naive_ratio(x, y)) and k.token_set(x, y) == pytest.approx(naive_token_set(x, y)), (x, y)
