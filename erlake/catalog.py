"""All queries of the record-linkage engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as t
from .operators import blocking as b
from .operators import analysis as a_
from .operators import metrics as m
from .operators import scoring
from .operators import tfidf
from .plans import sql as s
from .functions import kernels
from .sources import index
from .sources.records import demo_records, parse_truth

PER_KEY, CAP = 30, 20


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return demo_records(spark, sf)


#: The code that the index depends on.
_INDEX_CODE = ("functions/text.py", "operators/blocking.py", "sources/records.py")


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """The block index: all records with their normal forms, geography, tokens and grams, stored once for an input."""
    inputs = spark.read.parquet(f"{sf}/documents.parquet").inputFiles()
    return index.resumed(spark, "index", index.manifest(spark, inputs, _INDEX_CODE), lambda: b.with_keys(_records(spark, sf)))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """All records with their normal names and addresses, stored once for an input, for queries that need no more."""
    inputs = spark.read.parquet(f"{sf}/documents.parquet").inputFiles()
    return index.resumed(spark, "texts", index.manifest(spark, inputs, _INDEX_CODE), lambda: b.with_texts(_records(spark, sf)))


def _truth(keys: DataFrame) -> DataFrame:
    n = F.split_part("entity_id", F.lit("-"), F.lit(2)).alias("n")
    a, c = keys.where("source = 'S1'").select(F.col("entity_id").alias("s1"), n), keys.where("source <> 'S1'").select(F.col("entity_id").alias("candidate"), n)
    return a.join(c, "n").select("s1", "candidate")


def _anchors(keys: DataFrame) -> DataFrame:
    return keys.where("source = 'S1'").select(F.col("entity_id").alias("s1"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return b.route_pairs(_keys(spark, sf), PER_KEY)


def _minimum_slice(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    pairs = b.route_pairs(keys, PER_KEY, ("country_pin_name",)).select("s1", "candidate")
    return m.volume(_anchors(keys), pairs, keys.where("source <> 'S1'"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored_candidates(_keys(spark, sf), PER_KEY)


def _cap_quota(spark: SparkSession, sf: str) -> DataFrame:
    # a quota of CAP takes none but the first CAP of a source; one more shows that a union isn't small
    return b.quota_cap(scoring.scored_candidates(_keys(spark, sf), PER_KEY, top=CAP + 1), CAP).select("s1", "candidate")


def _hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    truth = _truth(keys)
    return b.hard_negatives(scoring.scored_candidates(keys, PER_KEY, left_out=truth, top=b.NEGATIVES, largest=True), truth).select("s1", "candidate")


def _rule_matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, truth, predicted): pairs of the postal-and-name route, the simplest matcher."""
    keys = _keys(spark, sf)
    return _anchors(keys), _truth(keys), b.route_pairs(keys, PER_KEY, ("country_pin_name",)).select("s1", "candidate")


def _set_features(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    pairs = b.route_pairs(keys, PER_KEY, ("country_pin_name",)).select("s1", "candidate")
    fuzzy = ("name_ratio", "name_token_ratio", "name_jaro", "address_ratio", "address_token_ratio")
    f = b.features(b.paired(pairs, keys)).drop(*fuzzy)
    return f.select("s1", "candidate", *[F.round(F.col(x).cast("double"), 4).alias(x) for x in f.columns[2:]])


def _all_features(spark: SparkSession, sf: str) -> DataFrame:
    """All 28; five of them are ratios that SQL lacks."""
    keys = _keys(spark, sf)
    return b.features(b.paired(b.route_pairs(keys, PER_KEY, ("country_pin_name",)).select("s1", "candidate"), keys))


def _tfidf(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf)
    side = lambda where: texts.where(where).select(F.col("entity_id").alias("id"), F.col("name_n").alias("text"))
    return tfidf.top_k(side("source = 'S1'"), side("source <> 'S1'"), 5)


def _source_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).withColumn("source", F.split_part("entity_id", F.lit("-"), F.lit(1)))
    blank = lambda x: F.count_if(F.trim(F.col(x)) == "")
    return r.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_ids"), F.count_distinct("business_name").alias("n_names"), blank("business_address").alias("no_address"), blank("business_name").alias("no_name"), F.sum(F.length("business_address") - F.length(F.replace("business_address", F.lit(","), F.lit("")))).alias("commas"), F.count_if(F.col("business_name").rlike("[^\\x00-\\x7f]")).alias("non_ascii"), F.count_if(~F.col("entity_id").rlike("^S[123]-[0-9]+$")).alias("bad_ids"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """(s1, candidate, a, b): both raw names of each true link."""
    keys = _keys(spark, sf)
    side = lambda x, y: keys.select(F.col("entity_id").alias(x), F.col("business_name").alias(y))
    return _truth(keys).join(side("s1", "a"), "s1").join(side("candidate", "b"), "candidate")


def _jaccards(spark: SparkSession, sf: str) -> DataFrame:
    f = _set_features(spark, sf)
    return f.select("s1", "candidate", F.round((F.col("name_jaccard") + F.col("address_jaccard")) / 2, 4).alias("score"), "name_jaccard", "address_jaccard")


def _ranked_pin(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("s1").orderBy("candidate"))
    return _rule_matches(spark, sf)[2].withColumn("rank", rank)


def _prf(spark: SparkSession, sf: str) -> DataFrame:
    c = m.per_anchor(*_rule_matches(spark, sf))
    alone = F.col("actual") == 0
    return c.agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("actual").alias("actual"), F.count_if(alone).alias("singletons"), F.count_if(alone & (F.col("pred") == 0)).alias("singletons_right"))


def _validate(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, predicted = _rule_matches(spark, sf)
    return a_.validate(anchors, truth, predicted, _records(spark, sf), truth.select("s1").distinct())


def _truth_parse(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    lists = _anchors(keys).join(_truth(keys), "s1", "left").groupBy(F.col("s1").alias("source1_entity_id")).agg(F.array_join(F.collect_list("candidate"), " , ").alias("matched_entity_ids"))
    return parse_truth(lists)


def _union_best(spark: SparkSession, sf: str) -> DataFrame:
    j = _jaccards(spark, sf)
    one = lambda col, name: j.select("s1", "candidate", F.col(col).alias("score"), F.lit(name).alias("method"))
    return b.union_best([one("name_jaccard", "name"), one("address_jaccard", "address")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    col = F.col
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "minimum_slice": _minimum_slice,
        "norm_name": lambda x, f: _keys(x, f).select("entity_id", "name_n", "addr_n"),
        "norm_experiment": lambda x, f: _records(x, f).select("entity_id", t.folded(col("business_name"), False).alias("n")).select("entity_id", t.normalize_experiment(col("n")).alias("norm")),
        "country_key": lambda x, f: _keys(x, f).select("entity_id", "country_key"),
        "geo_keys": lambda x, f: _keys(x, f).select("entity_id", "state", "postal", "city"),
        "informative_tokens": lambda x, f: _keys(x, f).select("entity_id", F.array_join("name_tokens", "|").alias("name_tokens"), F.array_join("address_tokens", "|").alias("address_tokens")),
        "numeric_components": lambda x, f: _keys(x, f).select("entity_id", F.array_join("numbers", "|").alias("numbers")),
        "approx_grams": lambda x, f: _keys(x, f).select("entity_id", F.array_join("name_grams", "|").alias("name_grams"), F.array_join("address_grams", "|").alias("address_grams")),
        "hash_sample": lambda x, f: _records(x, f).where(t.hash_sample(col("entity_id"), 7)).select("entity_id"),
        "folds": lambda x, f: _records(x, f).where(col("entity_id").startswith("S1-")).select("entity_id", t.fold(col("entity_id")).alias("fold")),
        "route_union": lambda x, f: b.union_pairs(_pairs(x, f)).select("s1", "candidate", F.array_join("routes", ",").alias("routes")),
        "route_unique": lambda x, f: (lambda k: m.route_report(b.route_pairs(k, PER_KEY), _truth(k)))(_keys(x, f)),
        "source_recall": lambda x, f: (lambda k: m.source_recall(_truth(k), b.route_pairs(k, PER_KEY)))(_keys(x, f)),
        "volume_summary": lambda x, f: (lambda k: m.volume(_anchors(k), b.route_pairs(k, PER_KEY).select("s1", "candidate").distinct(), k.where("source <> 'S1'")))(_keys(x, f)),
        "missed_links": lambda x, f: (lambda k: _truth(k).join(b.route_pairs(k, PER_KEY), ["s1", "candidate"], "left_anti"))(_keys(x, f)),
        "macro_f05": lambda x, f: m.macro_f(m.per_anchor(*_rule_matches(x, f)), 0.25),
        "macro_f1": lambda x, f: m.macro_f(m.per_anchor(*_rule_matches(x, f)), 1.0),
        "pair_features_set": _set_features,
        "levenshtein_sim": lambda x, f: (lambda k: _truth(k).join(k.select(col("entity_id").alias("s1"), col("name_n").alias("a")), "s1").join(k.select(col("entity_id").alias("candidate"), col("name_n").alias("b")), "candidate").select("s1", "candidate", F.round(t.levenshtein_similarity(col("a"), col("b")), 6).alias("sim")))(_keys(x, f)),
        "char_tfidf_topk": _tfidf,
        "source_profile": _source_profile,
        "country_pivot": lambda x, f: _records(x, f).withColumn("source", F.split_part("entity_id", F.lit("-"), F.lit(1))).groupBy("country").pivot("source", ["S1", "S2", "S3"]).count().na.fill(0),
        "truth_profile": lambda x, f: (lambda k: _anchors(k).join(_truth(k).groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0).groupBy(F.least("n", F.lit(4)).alias("matches")).agg(F.count("*").alias("anchors"), F.sum("n").alias("links")))(_keys(x, f)),
        "name_groups": lambda x, f: _records(x, f).groupBy(F.upper("business_name").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("business_address").alias("addresses"), F.array_join(F.array_sort(F.collect_set(F.split_part("entity_id", F.lit("-"), F.lit(1)))), ",").alias("sources")).where("n > 1"),
        "submission_lists": lambda x, f: (lambda a, _, p: a.join(p, "s1", "left").groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias("ids")))(*_rule_matches(x, f)),
        "candidate_rank": lambda x, f: _scored(x, f).select("s1", "candidate", F.round("score", 6).alias("score"), F.round("second", 6).alias("second")),
        "cap_quota": _cap_quota,
        "hard_negatives": _hard_negatives,
    }
    q |= {
        "lookup_keys": lambda x, f: _keys(x, f).select("entity_id", t.lookup_keys(col("name_n"), col("addr_n")).alias("k")).select("entity_id", "k.*"),
        "jaro_winkler": lambda x, f: _names(x, f).select("s1", "candidate", F.round(kernels.jaro_winkler_similarity("a", "b"), 6).alias("sim")),
        "norm_stages": lambda x, f: a_.normalisation_stages(_names(x, f)),
        "truth_parse": _truth_parse,
        "pair_prf": _prf,
        "topk_eval": lambda x, f: (lambda k: m.top_k(_anchors(k), _truth(k), _ranked_pin(x, f), [1, 2, 5]))(_keys(x, f)),
        "threshold_sweep": lambda x, f: (lambda k: m.threshold_sweep(_anchors(k), _truth(k), _jaccards(x, f).select("s1", "candidate", col("score").alias("p"))))(_keys(x, f)),
        "union_best": _union_best,
        "score_regions": lambda x, f: _jaccards(x, f).groupBy(a_.score_region(col("name_jaccard"), col("address_jaccard")).alias("region")).agg(F.count("*").alias("n")),
        "top1_gap": lambda x, f: a_.top_gap(_jaccards(x, f)),
        "describe_features": lambda x, f: a_.describe(_jaccards(x, f), "name_jaccard"),
        "score_histogram": lambda x, f: a_.histogram(_jaccards(x, f), "score", 0.0, 1.01, 25),
        "country_profile": lambda x, f: _records(x, f).groupBy("country").agg(F.count("*").alias("n"), F.count_if(col("business_address") == "").alias("no_address"), F.sum(F.length("business_name")).alias("name_chars"), F.round(F.avg(col("business_address").rlike("[0-9]{5}").cast("double")), 6).alias("five_digits")),
        "dup_prefix": lambda x, f: a_.before_first_repeat(x.read.parquet(f"{f}/documents.parquet").select((col("doc_id") % 151).alias("id"), col("doc_id").alias("pos"))),
        "submission_validate": _validate,
    }
    q["pair_features"] = _all_features
    for route in b.ROUTES:
        q[f"route_{route}"] = lambda x, f, route=route: b.route_pairs(_keys(x, f), PER_KEY, (route,)).select("s1", "candidate")
    from . import reports

    return q | reports.queries()


def oracle_sql() -> dict[str, str]:
    k, p = f"WITH {s.KEYS}", f"WITH {s.pairs(PER_KEY, b.ROUTES)}"
    pt = f"{p}, {s.TRUTH}"
    one = f"WITH {s.pairs(PER_KEY, ('country_pin_name',))}"
    one_t = f"{one}, {s.TRUTH}"
    pin = "pred AS (SELECT s1, candidate FROM pairs WHERE route = 'country_pin_name')"
    volume = "SELECT count(*) AS anchors, sum(n)::BIGINT AS candidates, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n > 100) AS over_100, round(1 - sum(n) / (count(*) * (SELECT count(*) FROM keys WHERE source <> 'S1')), 6) AS reduction FROM (SELECT k.entity_id, count(p.candidate) AS n FROM keys k LEFT JOIN {x} p ON p.s1 = k.entity_id WHERE k.source = 'S1' GROUP BY 1)"
    counts = f"{one_t}, {pin}, n AS (SELECT k.entity_id AS s1, (SELECT count(*) FROM truth t WHERE t.s1 = k.entity_id) AS a, (SELECT count(*) FROM pred p WHERE p.s1 = k.entity_id) AS p, (SELECT count(*) FROM pred p JOIN truth t ON p.s1 = t.s1 AND p.candidate = t.candidate WHERE p.s1 = k.entity_id) AS tp FROM keys k WHERE source = 'S1')"
    f = "SELECT round(avg(CASE WHEN a = 0 AND p = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE {b1} * (tp / p) * (tp / a) / ({b} * (tp / p) + tp / a) END), 6) AS score FROM n"
    jac = lambda x, y: f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END"
    fl = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
    agree = lambda x: fl(f"a_{x} <> '' AND a_{x} = b_{x}")
    clash = lambda x: fl(f"a_{x} <> '' AND b_{x} <> '' AND a_{x} <> b_{x}")
    ratio = lambda x: f"CASE WHEN a_{x} <> '' AND b_{x} <> '' THEN least(length(a_{x}), length(b_{x})) / greatest(length(a_{x}), length(b_{x})) ELSE 0.0 END"
    tok = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda z: z <> ''))"
    num = lambda x: rf"list_filter({tok(x)}, lambda z: regexp_full_match(z, '\p{{Nd}}+'))"
    cols = "name_n addr_n country country_key state postal city".split()
    feature = {"name_jaccard": jac("ta", "tb"), "address_jaccard": jac("da", "db"), "number_jaccard": jac("na", "nb"), "number_agreement": fl("len(list_intersect(na, nb)) > 0"), "number_conflict": fl("len(na) > 0 AND len(nb) > 0 AND len(list_intersect(na, nb)) = 0"), "name_length_ratio": ratio("name_n"), "address_length_ratio": ratio("addr_n"), "name_exact": agree("name_n"), "address_exact": agree("addr_n"), "country_agreement": fl("a_country <> '' AND a_country_key = b_country_key"), "candidate_is_s3": fl("candidate LIKE 'S3-%'"), "name_missing": fl("a_name_n = '' OR b_name_n = ''"), "address_missing": fl("a_addr_n = '' OR b_addr_n = ''"), "shared_postal_like": fl("len(list_filter(list_intersect(na, nb), lambda z: length(z) BETWEEN 5 AND 6)) > 0"), "state_agreement": agree("state"), "postal_agreement": agree("postal"), "city_agreement": agree("city"), "name_token_overlap": jac("ta", "tb"), "address_token_overlap": jac("da", "db"), "country_conflict": fl("a_country <> '' AND b_country <> '' AND a_country_key <> b_country_key"), "state_conflict": clash("state"), "postal_conflict": clash("postal"), "city_conflict": clash("city")}
    wide = ", ".join(f"a.{x} AS a_{x}, b.{x} AS b_{x}" for x in cols)
    out = {
        "minimum_slice": f"{one}, {pin} " + volume.replace("{x}", "pred"),
        "norm_name": f"WITH {s.NORMAL} SELECT entity_id, name_n, addr_n FROM base",
        "norm_experiment": rf"WITH {s.NORMAL} SELECT entity_id, trim(regexp_replace(regexp_replace(replace(lower(business_name), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM base",
        "country_key": f"{k} SELECT entity_id, country_key FROM keys",
        "geo_keys": f"{k} SELECT entity_id, state, postal, city FROM keys",
        "informative_tokens": f"{k} SELECT entity_id, array_to_string(name_tokens, '|') AS name_tokens, array_to_string(address_tokens, '|') AS address_tokens FROM keys",
        "numeric_components": f"{k} SELECT entity_id, array_to_string(numbers, '|') AS numbers FROM keys",
        "approx_grams": f"{k} SELECT entity_id, array_to_string(name_grams, '|') AS name_grams, array_to_string(address_grams, '|') AS address_grams FROM keys",
        "hash_sample": f"WITH {s.NORMAL} SELECT entity_id FROM base WHERE {s.CRC.replace('{x}', 'entity_id')} % 7 = 0",
        "folds": f"WITH {s.NORMAL}, h AS (SELECT entity_id, {s.CRC.replace('{x}', "entity_id || 'fold'")} % 10 AS h FROM base WHERE source = 'S1') SELECT entity_id, CASE h WHEN 0 THEN 'calibration' WHEN 1 THEN 'validation' ELSE 'train' END AS fold FROM h",
        "route_union": f"{p} SELECT s1, candidate, string_agg(route, ',' ORDER BY route) AS routes FROM pairs GROUP BY ALL",
        "route_unique": f"{pt}, n AS (SELECT s1, candidate, count(*) AS n FROM pairs GROUP BY ALL) SELECT p.route, count(*) AS candidates, count(t.s1) AS links, count(*) FILTER (n.n = 1) AS unique_candidates, count(t.s1) FILTER (n.n = 1) AS unique_links FROM pairs p JOIN n USING (s1, candidate) LEFT JOIN truth t USING (s1, candidate) GROUP BY 1",
        "source_recall": f"{pt}, d AS (SELECT DISTINCT s1, candidate FROM pairs) SELECT split_part(t.candidate, '-', 1) AS source, count(*) AS links, count(d.s1) AS found FROM truth t LEFT JOIN d ON d.s1 = t.s1 AND d.candidate = t.candidate GROUP BY 1",
        "volume_summary": f"{p}, d AS (SELECT DISTINCT s1, candidate FROM pairs) " + volume.replace("{x}", "d"),
        "missed_links": f"{pt} SELECT s1, candidate FROM truth ANTI JOIN pairs USING (s1, candidate)",
        "macro_f05": f"{counts} {f.replace('{b1}', '1.25').replace('{b}', '0.25')}",
        "macro_f1": f"{counts} {f.replace('{b1}', '2').replace('{b}', '1')}",
        "pair_features_set": f"{one}, {pin}, j AS (SELECT p.s1, p.candidate, {wide} FROM pred p JOIN keys a ON a.entity_id = p.s1 JOIN keys b ON b.entity_id = p.candidate), l AS (SELECT *, {tok('a_name_n')} AS ta, {tok('b_name_n')} AS tb, {tok('a_addr_n')} AS da, {tok('b_addr_n')} AS db, {num('a_addr_n')} AS na, {num('b_addr_n')} AS nb FROM j) SELECT s1, candidate, {', '.join(f'round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) AS {n}' for n, v in feature.items())} FROM l",
        "levenshtein_sim": rf"{k}, {s.TRUTH}, x AS (SELECT s1, candidate, {s.one_byte('a.name_n')} AS a, {s.one_byte('b.name_n')} AS b FROM truth JOIN keys a ON a.entity_id = s1 JOIN keys b ON b.entity_id = candidate) SELECT s1, candidate, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS sim FROM x",
        "char_tfidf_topk": f"""{k}, d AS (SELECT entity_id AS id, source = 'S1' AS q, name_n AS x FROM keys), g AS (SELECT id, q, unnest({s.char_grams('x', 2, 5)}) AS g FROM d), tf AS (SELECT id, q, g, count(*) AS tf FROM g GROUP BY ALL),
            df AS (SELECT g, ln((1 + (SELECT count(*) FROM d WHERE NOT q)) / (1 + count(*))) + 1 AS idf FROM tf WHERE NOT q GROUP BY g HAVING count(*) >= 2), w AS (SELECT id, q, g, tf * idf AS w FROM tf JOIN df USING (g)), u AS (SELECT id, q, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
            s AS (SELECT a.id AS s1, b.id AS candidate, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.g = b.g AND a.q AND NOT b.q GROUP BY ALL) SELECT s1, candidate, score, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, candidate DESC) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
        "source_profile": rf"WITH {s.NORMAL} SELECT source, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(DISTINCT business_name) AS n_names, count(*) FILTER (trim(business_address) = '') AS no_address, count(*) FILTER (trim(business_name) = '') AS no_name, sum(length(business_address) - length(replace(business_address, ',', '')))::BIGINT AS commas, count(*) FILTER (regexp_matches(business_name, '[^\x00-\x7f]')) AS non_ascii, count(*) FILTER (NOT regexp_full_match(entity_id, 'S[123]-[0-9]+')) AS bad_ids FROM base GROUP BY 1",
        "country_pivot": f'WITH {s.NORMAL} SELECT country, count(*) FILTER (source = \'S1\') AS "S1", count(*) FILTER (source = \'S2\') AS "S2", count(*) FILTER (source = \'S3\') AS "S3" FROM base GROUP BY 1',
        "truth_profile": f"{k}, {s.TRUTH}, n AS (SELECT k.entity_id, count(t.s1) AS n FROM keys k LEFT JOIN truth t ON t.s1 = k.entity_id WHERE source = 'S1' GROUP BY 1) SELECT least(n, 4) AS matches, count(*) AS anchors, sum(n)::BIGINT AS links FROM n GROUP BY 1",
        "name_groups": f"WITH {s.NORMAL} SELECT upper(replace(business_name, 'ß', 'ss')) AS name, count(*) AS n, count(DISTINCT business_address) AS addresses, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM base GROUP BY 1 HAVING count(*) > 1",
        "submission_lists": f"{one}, {pin} SELECT k.entity_id AS s1, coalesce(string_agg(DISTINCT pred.candidate, ',' ORDER BY pred.candidate), '') AS ids FROM keys k LEFT JOIN pred ON pred.s1 = k.entity_id WHERE k.source = 'S1' GROUP BY 1",
    }
    names = rf"{k}, {s.TRUTH}, nm AS (SELECT s1, candidate, a.business_name AS a, b.business_name AS b FROM truth JOIN keys a ON a.entity_id = s1 JOIN keys b ON b.entity_id = candidate)"
    j = f"WITH jj AS ({out['pair_features_set']}), j AS (SELECT *, round((name_jaccard + address_jaccard) / 2, 4) AS score FROM jj)"
    short = " ".join(f"WHEN '{full}' THEN '{abbr}'" for abbr, full in t.LEGAL.items())
    words = "list_filter(string_split({x}, ' '), lambda z: z <> '')"
    steps = {"raw": "{x}", "casefold": "lower(replace({x}, 'ß', 'ss'))", "unicode": "nfc_normalize({x})", "ampersand": "replace({x}, '&', ' and ')", "punctuation": r"regexp_replace({x}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')", "whitespace": r"trim(regexp_replace({x}, '\s+', ' ', 'g'))", "legal_suffix": f"array_to_string(list_transform({words}, lambda z: CASE z {short} ELSE z END), ' ')", "token_sort": f"array_to_string(list_sort({words}), ' ')"}
    x, y, stages = "a", "b", []
    for label, step in steps.items():
        x, y = step.format(x=x), step.format(x=y)
        stages.append(f"SELECT '{label}' AS stage, {x} <> '' AND {x} = {y} AS equal, {x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x})) AS held FROM nm")
    share = lambda z: f"round(avg(CASE WHEN {z} THEN 1.0 ELSE 0.0 END), 6) AS {z}"
    out |= {
        "lookup_keys": f"{k}, w AS (SELECT *, coalesce({s.longest('name_n', f'length(z) >= 3 AND z NOT IN ({s._in(s.NAME_STOP)})', 1)}[1], '') AS lt, coalesce({s.longest('addr_n', f'length(z) >= 4 AND z NOT IN ({s._in(s.ADDRESS_STOP)}) AND NOT {s._DIGITS}', 1)}[1], '') AS at_, coalesce({s.longest('addr_n', s._DIGITS, 1)}[1], '') AS nn FROM keys) SELECT entity_id, substring(replace(name_n, ' ', ''), 1, 6) AS prefix, substring(lt, 1, 10) AS long_token, CASE WHEN nn <> '' AND at_ <> '' THEN nn || ':' || substring(at_, 1, 8) ELSE '' END AS address_key FROM w",
        "jaro_winkler": f"{names} SELECT s1, candidate, round(jaro_winkler_similarity({s.one_byte('a')}, {s.one_byte('b')}), 6) AS sim FROM nm",
        "norm_stages": f"{names}, st AS ({' UNION ALL '.join(stages)}) SELECT stage, {share('equal')}, {share('held')} FROM st GROUP BY 1",
        "truth_parse": f"{k}, {s.TRUTH} SELECT s1, candidate FROM truth",
        "pair_prf": f"{counts} SELECT sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS pred, sum(a)::BIGINT AS actual, count(*) FILTER (a = 0) AS singletons, count(*) FILTER (a = 0 AND p = 0) AS singletons_right FROM n",
        "topk_eval": f"{one_t}, {pin}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY candidate) AS rank FROM pred), h AS (SELECT k.k, t.s1, count(*) AS links, count(*) FILTER (r.rank <= k.k) AS hits FROM truth t CROSS JOIN (VALUES (1), (2), (5)) k(k) LEFT JOIN r ON r.s1 = t.s1 AND r.candidate = t.candidate GROUP BY ALL) SELECT k, sum(links)::BIGINT AS links, sum(hits)::BIGINT AS found, round(sum(hits) / sum(links), 6) AS recall, round(count(*) FILTER (hits = links) / count(*), 6) AS full_hit_rate, (sum(links) - sum(hits))::BIGINT AS missed FROM h GROUP BY k",
        "threshold_sweep": f"{j}, kk AS ({k}, {s.TRUTH} SELECT a.entity_id AS s1, t.candidate FROM keys a LEFT JOIN truth t ON t.s1 = a.entity_id WHERE a.source = 'S1'), st AS (SELECT i * 0.05::DOUBLE AS t FROM range(1, 20) r(i)), act AS (SELECT s1, count(candidate) AS a FROM kk GROUP BY 1), pr AS (SELECT j.s1, st.t, count(*) AS p, count(kk.candidate) AS tp FROM j JOIN st ON j.score >= st.t LEFT JOIN kk ON kk.s1 = j.s1 AND kk.candidate = j.candidate GROUP BY ALL), n AS (SELECT act.s1, st.t, act.a, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM act CROSS JOIN st LEFT JOIN pr ON pr.s1 = act.s1 AND pr.t = st.t) SELECT round(t, 2) AS threshold, round(avg(CASE WHEN a = 0 AND p = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / p) * (tp / a) / (0.25 * (tp / p) + tp / a) END), 6) AS score FROM n GROUP BY t",
        "union_best": f"{j} SELECT s1, candidate, greatest(name_jaccard, address_jaccard) AS score, CASE WHEN name_jaccard >= address_jaccard THEN 'name' ELSE 'address' END AS method FROM j",
        "score_regions": f"{j} SELECT CASE WHEN name_jaccard >= 0.8 AND address_jaccard >= 0.7 THEN 'both' WHEN name_jaccard >= 0.8 THEN 'name' WHEN address_jaccard >= 0.7 THEN 'address' ELSE 'neither' END AS region, count(*) AS n FROM j GROUP BY 1",
        "top1_gap": f"{j}, r AS (SELECT s1, candidate, score, row_number() OVER w AS n, lead(score) OVER w AS nx FROM j WINDOW w AS (PARTITION BY s1 ORDER BY score DESC, candidate)) SELECT s1, candidate, score, round(score - coalesce(nx, 0), 6) AS gap FROM r WHERE n = 1",
        "describe_features": f"{j} SELECT count(name_jaccard) AS n, round(avg(name_jaccard), 6) AS mean, round(stddev_samp(name_jaccard), 6) AS std, min(name_jaccard) AS low, max(name_jaccard) AS high, {', '.join(f'round(quantile_cont(name_jaccard, {v}), 6) AS p{int(100 * v)}' for v in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9))} FROM j",
        "score_histogram": f"{j} SELECT CAST(floor(score / 1.01 * 25) AS BIGINT) + 1 AS bin, count(*) AS n FROM j GROUP BY 1",
        "country_profile": f"WITH {s.NORMAL} SELECT country, count(*) AS n, count(*) FILTER (business_address = '') AS no_address, sum(length(business_name))::BIGINT AS name_chars, round(avg(CASE WHEN regexp_matches(business_address, '[0-9]{{5}}') THEN 1.0 ELSE 0.0 END), 6) AS five_digits FROM base GROUP BY 1",
        "dup_prefix": "WITH r AS (SELECT doc_id % 151 AS id, doc_id AS pos, row_number() OVER (PARTITION BY doc_id % 151 ORDER BY doc_id) AS n FROM documents) SELECT id, pos FROM r WHERE pos < coalesce((SELECT min(pos) FROM r WHERE n > 1), 9223372036854775807)",
        "submission_validate": f"{one_t}, {pin} SELECT 'duplicate_ids' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'match_not_candidate', count(*) FROM truth ANTI JOIN pred USING (s1, candidate) UNION ALL SELECT 'unknown_id', count(*) FROM pred WHERE candidate NOT IN (SELECT entity_id FROM keys) UNION ALL SELECT 'unknown_anchor', count(*) FROM pred WHERE s1 NOT IN (SELECT entity_id FROM keys) UNION ALL SELECT 'anchor_without_row', count(*) FROM keys WHERE source = 'S1' AND entity_id NOT IN (SELECT s1 FROM truth) UNION ALL SELECT 'wrong_source', 0",
    }
    for route in b.ROUTES:
        out[f"route_{route}"] = f"WITH {s.pairs(PER_KEY, (route,))} SELECT s1, candidate FROM pairs WHERE route = '{route}'"
    from . import reports

    return out | reports.oracle_sql(out["pair_features_set"])
