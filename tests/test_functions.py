import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from erlake.functions import kernels as k
from erlake.functions import text as t
from erlake.operators import blocking as b
from erlake.operators import metrics as m
from erlake.sources import records


def naive_lcs(a, b_):
    row = [0] * (len(b_) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b_):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_kernels(a, c):
    assert k.lcs(a, c) == naive_lcs(a, c)
    for f in (k.indel, k.token_set, k.jaro_winkler):
        assert 0 <= f(a, c) <= 1
    assert k.indel(a, a) == 1 and k.jaro_winkler(a, a) == 1
    assert k.indel(a, c) == k.indel(c, a)


def test_jaro_winkler_as_duckdb():
    import duckdb

    rng, con = random.Random(3), duckdb.connect()
    for _ in range(200):
        a, c = ("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert k.jaro_winkler(a, c) == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [a, c]).fetchone()[0])


def test_normalisers(spark):
    df = spark.createDataFrame([("℡ Straße & Co/Ltd",), (None,), ("###",)], "x string").select("x", t.folded(F.col("x")).alias("a"), t.folded(F.col("x"), False).alias("b"))
    got = [tuple(r) for r in df.select(t.normalize(F.col("a"), name=True), t.normalize_experiment(F.col("b"))).collect()]
    assert got == [("TEL strasse and company limited", "tel strasse co ltd"), ("", ""), ("", "")]


@pytest.mark.parametrize(("address", "country", "want"), [("12 Main St, Fresno, CA, 90210", "US", ("ca", "90210", "fresno")), ("12 MG Road, Pune, Maharashtra, 560001", "India", ("maharashtra", "560001", "pune")), ("5 rue X, Lyon, 69001", "France", ("", "69001", "lyon")), (None, None, ("", "", "")), ("CA, Fresno", "usa", ("ca", "", "fresno"))])
def test_geography(spark, address, country, want):
    df = spark.createDataFrame([("S1-1", "x", address, country)], records.RECORD)
    assert tuple(b.with_keys(df).select("state", "postal", "city").first()) == want


def test_macro_f05_worked_example(spark):
    anchors = spark.createDataFrame([("a",), ("none",), ("wrong",)], "s1 string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y")], "s1 string, candidate string")
    pred = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "s1 string, candidate string")
    one = m.per_anchor(anchors.where("s1 = 'a'"), truth, pred)
    assert m.macro_f(one, 0.25).first()[0] == pytest.approx(0.714, abs=1e-3)
    assert m.macro_f(m.per_anchor(anchors.where("s1 = 'none'"), truth, pred), 0.25).first()[0] == 1.0
    more = pred.union(spark.createDataFrame([("wrong", "x")], pred.schema))
    assert m.macro_f(m.per_anchor(anchors.where("s1 = 'wrong'"), truth, more), 0.25).first()[0] == 0.0


def test_quota_cap(spark):
    rows = [("a", f"S2-{i}", 100.0 - i, 0.0) for i in range(10)] + [("a", "S3-1", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "s1 string, candidate string, score double, second double")
    assert sorted(r.candidate for r in b.quota_cap(df, 5).collect()) == ["S2-0", "S2-1", "S2-2", "S2-3", "S3-1"]
    assert b.quota_cap(df, 11).count() == 11
    with pytest.raises(ValueError):
        b.quota_cap(df, 0)


def test_threshold_sweep_and_sources(spark, tmp_path):
    anchors = spark.createDataFrame([("a",), ("c",)], "s1 string")
    truth = spark.createDataFrame([("a", "x")], "s1 string, candidate string")
    scored = spark.createDataFrame([("a", "x", 0.9), ("c", "y", 0.4)], "s1 string, candidate string, p double")
    got = {r.threshold: r.score for r in m.threshold_sweep(anchors, truth, scored).collect()}
    assert len(got) == 19 and got[0.3] == 0.5 and got[0.5] == 1.0 and got[0.95] == 0.5
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-4\nS1-2\t\n")
    raw = records.read_truth(spark, str(tmp_path / "t.tsv"))
    assert sorted(map(tuple, records.parse_truth(raw).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-4")]
    records.check_truth(raw, spark.createDataFrame([("S1-1",)], "entity_id string"))
    with pytest.raises(ValueError):
        records.check_truth(raw, spark.createDataFrame([("S1-9",)], "entity_id string"))


def test_unknown_route(spark):
    with pytest.raises(ValueError):
        b.route_pairs(spark.createDataFrame([], records.RECORD), routes=("nowhere",))
