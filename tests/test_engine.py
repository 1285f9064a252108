import pytest
from pyspark.sql import functions as F

from erlake import catalog
from erlake.operators import blocking as b
from erlake.operators import model
from erlake.operators.base import CharTfidf
from erlake.streaming.resume import match_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def keys(spark):
    return b.with_keys(catalog._records(spark, SF)).cache()


def test_classifier_end_to_end(spark, keys, tmp_path):
    anchors, truth = catalog._anchors(keys), catalog._truth(keys)
    pairs = b.route_pairs(keys, 30, ("country_state_name", "country_multi_name_token")).select("s1", "candidate").distinct()
    both = b.paired(pairs, keys)
    features = b.features(both).cache()
    assert len(features.columns) == 30
    train = model.training_set(features, truth, b.hard_negatives(b.ranked(both), truth))
    fitted = model.fit(train, trees=3)
    scored = model.score(fitted, features).cache()
    assert scored.where("p < 0 OR p > 1").isEmpty() and scored.count() == pairs.count()
    best = model.best_threshold(anchors, truth, scored)
    assert 0.05 <= best <= 0.95
    lists = model.result_lists(anchors, scored.where(F.col("p") >= best))
    assert lists.count() == anchors.count()
    model.write_lists(lists.limit(50), str(tmp_path / "out"))
    done = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).select("source1_entity_id")
    model.write_lists(lists, str(tmp_path / "out"), done)
    again = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert again.count() == anchors.count() == again.select("source1_entity_id").distinct().count()
    with pytest.raises(ValueError):
        model.training_set(features.where("false"), truth, truth)


def test_blocker(keys):
    blocker = CharTfidf(low=3, high=3).fit(keys.where("source <> 'S1'"))
    got = blocker.retrieve(keys.where("source = 'S1'").limit(20), 3)
    assert got.where("rank > 3 OR score <= 0 OR score > 1.000001").isEmpty() and not got.isEmpty()
    with pytest.raises(ValueError):
        blocker.retrieve(keys, 0)
    with pytest.raises(ValueError):
        CharTfidf(low=3, high=2)


def test_anchor_stream_resumes(spark, keys, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    corpus = catalog._records(spark, SF).where("entity_id NOT LIKE 'S1-%'").cache()
    anchors = catalog._records(spark, SF).where("entity_id LIKE 'S1-%'")

    def match(batch):
        return b.route_pairs(b.with_keys(batch.unionByName(corpus)), 30, ("country_pin_name",)).select("s1", "candidate")

    for part in (0, 1):
        anchors.where(F.crc32(F.col("entity_id").cast("binary")) % 2 == part).coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(folder)
        match_stream(spark, folder, match, out, mark).awaitTermination()
    want = match(anchors)
    got = spark.read.parquet(out).select("s1", "candidate")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_ranking_takes_the_union_of_all_routes(spark, keys):
    want = b.route_pairs(keys, catalog.PER_KEY).select("s1", "candidate").distinct()
    got = catalog.queries()["candidate_rank"](spark, SF).select("s1", "candidate")
    assert got.count() == want.count() > b.route_pairs(keys, catalog.PER_KEY, ("country_pin_name", "country_state_name")).select("s1", "candidate").distinct().count()
    assert got.exceptAll(want).isEmpty()
