"""Queries and SQL of evaluations, profiles and exploratory features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as t
from .operators import blocking as b
from .operators import profile as pr
from .operators import retrieval as r
from .operators import tfidf
from .plans import sql as s
from .sources import sinks

CAPS, KS, MOST = [1, 3], [1, 2, 5], 120_000


def _c():
    from . import catalog

    return catalog


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return _c()._records(spark, sf).withColumn("source", F.split_part("entity_id", F.lit("-"), F.lit(1)))


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, truth, corpus)."""
    keys = _c()._keys(spark, sf)
    return _c()._anchors(keys), _c()._truth(keys), keys.where("source <> 'S1'")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _c()._jaccards(spark, sf).withColumn("second", F.col("name_jaccard"))


def _ranked(spark: SparkSession, sf: str, score: str) -> DataFrame:
    """Candidates ranked by one of the similarities, ties by id."""
    place = F.row_number().over(W.partitionBy("s1").orderBy(F.desc(score), "candidate"))
    return _c()._jaccards(spark, sf).select("s1", "candidate", F.col(score).alias("score"), "address_jaccard", place.alias("rank"))


def _ranked_pin(spark: SparkSession, sf: str) -> DataFrame:
    return _c()._ranked_pin(spark, sf)


def _ranked_state(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the state-and-name route, which holds wrong ones too, ranked by id."""
    pairs = b.route_pairs(_c()._keys(spark, sf), _c().PER_KEY, ("country_state_name",)).select("s1", "candidate")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("s1").orderBy("candidate")))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, corpus = _base(spark, sf)
    return r.evaluate_top_k(anchors, truth, _ranked_pin(spark, sf), corpus, KS)


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, corpus = _base(spark, sf)
    ranked = {m: _ranked(spark, sf, f"{m}_jaccard") for m in ("name", "address")}
    return r.evaluate_methods(anchors, truth, ranked, {"union": ("name", "address")}, corpus, KS)


def _capped(spark: SparkSession, sf: str) -> DataFrame:
    return b.quota_caps(_scored(spark, sf), CAPS)


def _caps(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, _ = _base(spark, sf)
    return r.cap_report(anchors, truth, _scored(spark, sf), _capped(spark, sf))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, _ = _base(spark, sf)
    return r.wide_sweep(anchors, truth, _capped(spark, sf).select("s1", "candidate", "cap", F.col("score").alias("p")))


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, _ = _base(spark, sf)
    return r.fold_counters(anchors, truth, _ranked_pin(spark, sf))


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the first wrong neighbours: from the linked records, else from all."""
    _, truth, corpus = _base(spark, sf)
    every = corpus.select(F.col("entity_id").alias("candidate"), "business_name", "country")
    linked = every.join(truth.select("candidate").distinct().where("candidate LIKE 'S2-%'"), "candidate", "left_semi")
    return r.filled(r.other_neighbours(_ranked_state(spark, sf), truth).select("s1", "candidate"), linked, every, ["business_name", "country"])


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    _, truth, _ = _base(spark, sf)
    label = F.when(F.col("hit").isNotNull(), "true").otherwise("other")
    return _c()._jaccards(spark, sf).join(truth.withColumn("hit", F.lit(1)), ["s1", "candidate"], "left").withColumn("label", label)


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    """True links with both records' normal name, address and country, as structs a and b."""
    keys = _c()._keys(spark, sf)
    side = lambda x, y: keys.select(F.col("entity_id").alias(x), F.struct(F.col("name_n").alias("name"), F.col("addr_n").alias("address"), "country").alias(y))
    return _c()._truth(keys).join(side("s1", "a"), "s1").join(side("candidate", "b"), "candidate")


def _eda_features(spark: SparkSession, sf: str) -> DataFrame:
    f = pr.pair_features(_sides(spark, sf))
    return f.select("s1", "candidate", *[F.round(F.col(x).cast("double"), 6).alias(x) for x in f.columns[2:]])


def _cosines(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise cosines of the true links: character and word grams of names, character grams of addresses."""
    texts = _c()._texts(spark, sf)
    of = {"name_char": ("name_n", False, 3, 5), "name_word": ("name_n", True, 1, 2), "address_char": ("addr_n", False, 3, 5)}
    found = tfidf.cosines_of_pairs(_c()._truth(texts), texts.withColumnRenamed("entity_id", "id"), of, 2, MOST)
    return found.select("s1", "candidate", *[F.round(x, 6).alias(x) for x in of])


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """The two aligned result files as one table, in the order of the anchors' numbers."""
    anchors, truth, _ = _base(spark, sf)
    number = F.split_part("s1", F.lit("-"), F.lit(2)).cast("long").alias("position")
    found = _ranked_pin(spark, sf)
    return sinks.aligned_lists(anchors.select("s1", number), found, found.join(truth, ["s1", "candidate"], "left_semi"))


def _zipped(spark: SparkSession, sf: str) -> DataFrame:
    lists = _lists(spark, sf)
    side = lists.select("position", F.col("source1_entity_id").alias("id"))
    return sinks.zipped(side, side)


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    anchors, truth, _ = _base(spark, sf)
    lists = anchors.join(truth.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_list("candidate")), ",").alias("matched")), "s1", "left").na.fill("")
    return r.restricted(lists, anchors.where(t.fold(F.col("s1")) == "validation"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    col = F.col
    return {
        "topk_report": _evaluated,
        "topk_reported": lambda x, f: r.reported(_evaluated(x, f)),
        "topk_missed": lambda x, f: r.missed_at_k(_base(x, f)[1], _ranked_pin(x, f), KS),
        "method_topk": _methods,
        "union_topk": lambda x, f: r.union_top_k(_ranked(x, f, "name_jaccard"), _ranked(x, f, "address_jaccard"), 2),
        "cap_many": lambda x, f: _capped(x, f).select("cap", "s1", "candidate"),
        "cap_recall": _caps,
        "wide_sweep": _sweep,
        "fold_counters": _folds,
        "other_neighbours": lambda x, f: r.other_neighbours(_ranked_state(x, f), _base(x, f)[1]).select("s1", "candidate", "place"),
        "filled_neighbours": _filled,
        "top_scores": lambda x, f: r.top_scores(_base(x, f)[0], _ranked(x, f, "name_jaccard"), "address_jaccard"),
        "label_stats": lambda x, f: r.by_label(_labelled(x, f), "label", ["name_jaccard", "address_jaccard"]),
        "wanted_truth": _wanted,
        "linked_records": lambda x, f: r.joined_once(_base(x, f)[1], _base(x, f)[2].select(col("entity_id").alias("candidate"), "country"), "candidate"),
        "source_shapes": lambda x, f: pr.shapes(_records(x, f)),
        "distinct_sketches": lambda x, f: pr.distinct_estimates(_records(x, f), ["entity_id", "business_name", "business_address"]),
        "common_names": lambda x, f: pr.most_common(_c()._keys(x, f), "name_n"),
        "name_duplicate_rate": lambda x, f: pr.duplicate_rate(_c()._keys(x, f), "name_n"),
        "malformed_ids": lambda x, f: pr.malformed(_records(x, f).select(F.when(F.length("business_address") == 0, F.concat(F.lit("x"), "entity_id")).otherwise(col("entity_id")).alias("entity_id")).union(_records(x, f).where("source = 'S3'").select("entity_id"))),
        "distinct_ids": lambda x, f: pr.one_of_each_id(_records(x, f).select(F.concat(F.lit("N-"), F.split_part("entity_id", F.lit("-"), F.lit(2))).alias("entity_id"), "business_name", "country")),
        "drawn_records": lambda x, f: pr.drawn(_records(x, f), "entity_id", 20, 2026).select("entity_id"),
        "record_page": lambda x, f: _records(x, f).orderBy("entity_id").offset(50).limit(50).select("entity_id"),
        "head_rows": lambda x, f: _records(x, f).orderBy("entity_id").limit(3).select("entity_id", "business_name"),
        "weakest_links": lambda x, f: _labelled(x, f).where("label = 'true'").orderBy("name_jaccard", "s1", "candidate").limit(15).select("s1", "candidate", "name_jaccard"),
        "hash_sample_64": lambda x, f: _records(x, f).where(t.hash_sample_64(col("entity_id"), 7)).select("entity_id"),
        "score_histogram_2d": lambda x, f: pr.histogram_2d(_c()._jaccards(x, f), "name_jaccard", "address_jaccard", 25),
        "truth_sources": lambda x, f: pr.truth_sources(*_base(x, f)[:2]),
        "eda_features": _eda_features,
        "row_cosines": _cosines,
        "aligned_lists": _lists,
        "zipped_ids": _zipped,
    }


def oracle_sql(features: str) -> dict[str, str]:
    """``features``: the statement of the set features that the scores are made of."""
    pin_pairs = s.pairs(_c().PER_KEY, ("country_pin_name",))
    pin = f"WITH {pin_pairs}, {s.TRUTH}, pred AS (SELECT s1, candidate FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY candidate) AS rank FROM pred), anchors AS (SELECT entity_id AS s1 FROM keys WHERE source = 'S1')"
    state = pin.replace(pin_pairs, s.pairs(_c().PER_KEY, ("country_state_name",)))
    k = f"WITH {s.KEYS.replace('keys AS (SELECT', 'keys AS MATERIALIZED (SELECT')}, {s.TRUTH}, anchors AS (SELECT entity_id AS s1 FROM keys WHERE source = 'S1')"
    n = f"WITH {s.NORMAL}"
    scored = "j AS MATERIALIZED (SELECT *, round((name_jaccard + address_jaccard) / 2, 4) AS score FROM jj)"
    j = f"{k}, jj AS ({features}), {scored}"
    ks = "(VALUES (1), (2), (5)) ks(k)"
    by = lambda x: f"(SELECT s1, candidate, {x} AS score, address_jaccard, row_number() OVER (PARTITION BY s1 ORDER BY {x} DESC, candidate) AS rank FROM j)"
    each = f"""each AS (SELECT a.s1, ks.k, (SELECT count(*) FROM truth t WHERE t.s1 = a.s1) AS links, (SELECT count(*) FROM ranked c WHERE c.s1 = a.s1 AND c.rank <= ks.k) AS n,
        (SELECT count(*) FROM ranked c JOIN truth t USING (s1, candidate) WHERE c.s1 = a.s1 AND c.rank <= ks.k) AS hits FROM anchors a CROSS JOIN {ks})"""
    report = f"""{pin}, {each}, size AS (SELECT count(*) AS z FROM keys WHERE source <> 'S1') SELECT k, round(sum(hits) / sum(links), 6) AS candidate_recall, round(count(*) FILTER (links = hits) / count(*), 6) AS full_hit_rate,
        round(count(*) FILTER (links = hits AND links > 0) / count(*) FILTER (links > 0), 6) AS non_singleton_full_hit_rate, round(avg(n), 6) AS avg_candidates, quantile_cont(n, 0.5) AS median_candidates, max(n) AS max_candidates,
        round(1 - sum(n) / (count(*) * (SELECT z FROM size)), 6) AS reduction_ratio, sum(links)::BIGINT AS true_links, sum(hits)::BIGINT AS retrieved_true_links, (sum(links) - sum(hits))::BIGINT AS missed_true_links,
        count(*) FILTER (links <> hits) AS affected_s1_entities, count(*) AS s1_entities, count(*) FILTER (links > 0) AS non_singleton_s1_entities, (SELECT z FROM size) AS candidate_corpus_records FROM each GROUP BY k"""
    caps = f"""{j}, o AS (SELECT s1, candidate, score, row_number() OVER (PARTITION BY s1, split_part(candidate, '-', 1) ORDER BY score DESC, name_jaccard DESC, candidate) AS own, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, name_jaccard DESC, candidate) AS place, count(*) OVER (PARTITION BY s1) AS every FROM j),
        q AS (SELECT o.*, c.cap, own <= c.cap // 2 AS fixed FROM o CROSS JOIN (VALUES ({CAPS[0]}), ({CAPS[1]})) c(cap)),
        z AS (SELECT *, row_number() OVER (PARTITION BY s1, cap ORDER BY fixed DESC, place) AS pos FROM q), capped AS MATERIALIZED (SELECT cap, s1, candidate, score FROM z WHERE every <= cap OR pos <= cap)"""
    counted = "(SELECT count(*) FROM truth t WHERE t.s1 = a.s1) AS links"
    methods = f"""{j}, nm AS (SELECT * FROM {by('name_jaccard')}), ad AS (SELECT * FROM {by('address_jaccard')}), lists AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'name' AS method, k, s1, candidate FROM nm JOIN {ks} ON rank <= k UNION ALL SELECT 'address', k, s1, candidate FROM ad JOIN {ks} ON rank <= k UNION ALL SELECT 'union', k, s1, candidate FROM nm JOIN {ks} ON rank <= k UNION ALL SELECT 'union', k, s1, candidate FROM ad JOIN {ks} ON rank <= k)),
        mk AS (SELECT m.method, ks.k FROM (VALUES ('name'), ('address'), ('union')) m(method) CROSS JOIN {ks}),
        sizes AS (SELECT mk.method, mk.k, a.s1, count(l.candidate) AS n FROM mk CROSS JOIN anchors a LEFT JOIN lists l ON l.method = mk.method AND l.k = mk.k AND l.s1 = a.s1 GROUP BY ALL),
        vol AS (SELECT method, k, round(avg(n), 6) AS avg_candidates, quantile_cont(n, 0.5) AS median_candidates, round(quantile_cont(n, 0.95), 6) AS p95_candidates, max(n) AS max_candidates FROM sizes GROUP BY ALL),
        hits AS (SELECT mk.method, mk.k, split_part(t.candidate, '-', 1) AS src, CASE WHEN l.s1 IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM mk CROSS JOIN truth t LEFT JOIN lists l ON l.method = mk.method AND l.k = mk.k AND l.s1 = t.s1 AND l.candidate = t.candidate),
        rec AS (SELECT method, k, count(*) AS true_pairs, round(100 * avg(hit), 6) AS recall_pct, round(100 * avg(hit) FILTER (src = 'S2'), 6) AS S2_recall_pct, round(100 * avg(hit) FILTER (src = 'S3'), 6) AS S3_recall_pct FROM hits GROUP BY ALL)
        SELECT rec.*, vol.avg_candidates, vol.median_candidates, vol.p95_candidates, vol.max_candidates, round(1 - avg_candidates / (SELECT count(*) FROM keys WHERE source <> 'S1'), 6) AS reduction_ratio FROM rec JOIN vol USING (method, k)"""
    sweep = f"""{caps}, st AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in r.wide_thresholds())}]) AS t), act AS (SELECT a.s1, {counted} FROM anchors a), pr AS (SELECT c.cap, st.t, c.s1, count(*) AS p, count(tr.s1) AS tp FROM capped c JOIN st ON c.score >= st.t LEFT JOIN truth tr ON tr.s1 = c.s1 AND tr.candidate = c.candidate GROUP BY ALL),
        m AS (SELECT cp.cap, st.t, act.links AS a, coalesce(pr.p, 0) AS p, coalesce(pr.tp, 0) AS tp FROM act CROSS JOIN st CROSS JOIN (VALUES ({CAPS[0]}), ({CAPS[1]})) cp(cap) LEFT JOIN pr ON pr.s1 = act.s1 AND pr.t = st.t AND pr.cap = cp.cap),
        f AS (SELECT cap, t, round(avg(CASE WHEN a = 0 AND p = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / p) * (tp / a) / ((tp / p) + tp / a) END), 9) AS f1, round(avg(CASE WHEN a = 0 AND p = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / p) * (tp / a) / (0.25 * (tp / p) + tp / a) END), 9) AS f05 FROM m GROUP BY ALL),
        l AS (SELECT cap, 'f1' AS metric, f1 AS score, t FROM f UNION ALL SELECT cap, 'f05', f05, t FROM f) SELECT cap, metric, round(score, 6) AS score, t AS threshold FROM l QUALIFY row_number() OVER (PARTITION BY cap, metric ORDER BY l.score DESC, t) = 1"""
    tok = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda z: z <> ''))"
    num = lambda x: rf"list_filter({tok(x)}, lambda z: regexp_full_match(z, '\p{{Nd}}+'))"
    jac = lambda x, y: f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END"
    flag = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
    post = lambda x: f"list_filter({x}, lambda z: length(z) BETWEEN 5 AND 6)"
    eda = {
        "name_exact": flag("an <> '' AND an = bn"), "name_levenshtein": f"CASE WHEN greatest(length(an), length(bn)) = 0 THEN 1.0 ELSE 1 - levenshtein({s.one_byte('an')}, {s.one_byte('bn')}) / greatest(length(an), length(bn)) END",
        "name_jaro_winkler": f"jaro_winkler_similarity({s.one_byte('an')}, {s.one_byte('bn')})", "name_token_jaccard": jac(tok("an"), tok("bn")), "address_token_jaccard": jac(tok("aa"), tok("ba")), "numeric_overlap": jac("na", "nb"),
        "numeric_any_agreement": flag("len(list_intersect(na, nb)) > 0"), "numeric_all_agreement": flag("len(na) > 0 AND list_sort(na) = list_sort(nb)"), "postal_agreement": flag(f"len(list_intersect({post('na')}, {post('nb')})) > 0"),
        "address_length_ratio": "CASE WHEN aa <> '' AND ba <> '' THEN least(length(aa), length(ba)) / greatest(length(aa), length(ba)) ELSE 0.0 END",
        "address_containment": f"CASE WHEN aa <> '' AND ba <> '' THEN len(list_intersect({tok('aa')}, {tok('ba')})) / least(len({tok('aa')}), len({tok('ba')})) ELSE 0.0 END", "country_agreement": flag("ac = bc"),
    }

    words = r"list_filter(string_split(regexp_replace(x, '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda z: length(z) >= 2)"
    pairs_of = f"list_transform(range(1, greatest(len({words}), 1)), lambda i: {words}[i] || ' ' || {words}[i + 1])"

    def cosine(name: str, column: str, grams: str) -> str:
        return f"""g_{name} AS (SELECT id, unnest({grams}) AS g FROM (SELECT entity_id AS id, {column} AS x FROM keys)), tf_{name} AS (SELECT id, g, count(*) AS tf FROM g_{name} GROUP BY ALL),
        df_{name} AS (SELECT g, ln((1 + (SELECT count(*) FROM keys)) / (1 + count(*))) + 1 AS idf FROM tf_{name} GROUP BY g HAVING count(*) >= 2 ORDER BY sum(tf) DESC, g LIMIT {MOST}), w_{name} AS (SELECT id, g, (1 + ln(tf)) * idf AS w FROM tf_{name} JOIN df_{name} USING (g)),
        u_{name} AS MATERIALIZED (SELECT id, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w_{name}), c_{name} AS (SELECT t.s1, t.candidate, sum(a.w * b.w) AS w FROM truth t JOIN u_{name} a ON a.id = t.s1 JOIN u_{name} b ON b.id = t.candidate AND a.g = b.g GROUP BY ALL)"""

    cosines = ", ".join([cosine("nc", "name_n", s.char_grams("x", 3, 5)), cosine("nw", "name_n", f"list_concat({words}, {pairs_of})"), cosine("ac", "addr_n", s.char_grams("x", 3, 5))])
    crc = lambda x: s.CRC.replace("{x}", x)
    stats = ", ".join(f"count({x}) AS {x}_count, round(quantile_cont({x}, 0.5), 6) AS {x}_median, round(avg({x}), 6) AS {x}_mean" for x in ("name_jaccard", "address_jaccard"))
    labelled = f"{j}, lab AS (SELECT j.*, CASE WHEN t.s1 IS NULL THEN 'other' ELSE 'true' END AS label FROM j LEFT JOIN truth t USING (s1, candidate))"
    number = "split_part({x}, '-', 2)::BIGINT"
    lists = f"""{pin} SELECT {number.format(x='a.s1')} AS position, a.s1 AS source1_entity_id, coalesce((SELECT string_agg(candidate, ',' ORDER BY candidate) FROM pred p WHERE p.s1 = a.s1), '') AS candidate_entity_ids,
        coalesce((SELECT string_agg(candidate, ',' ORDER BY candidate) FROM pred p JOIN truth t USING (s1, candidate) WHERE p.s1 = a.s1), '') AS matched_entity_ids FROM anchors a"""
    fold = f"CASE {crc('{x}')} % 10 WHEN 0 THEN 'calibration' WHEN 1 THEN 'validation' ELSE 'train' END"
    return {
        "topk_report": report,
        "topk_reported": f"SELECT k, printf('%.4f', round(candidate_recall, 4)) AS candidate_recall, printf('%.4f', round(full_hit_rate, 4)) AS full_hit_rate, printf('%.1f', round(avg_candidates, 1)) AS avg_candidates, missed_true_links FROM ({report})",
        "topk_missed": f"{pin} SELECT k, s1, candidate FROM truth CROSS JOIN {ks} ANTI JOIN (SELECT s1, candidate, k FROM ranked JOIN {ks} ON rank <= k) f USING (s1, candidate, k)",
        "method_topk": methods,
        "union_topk": f"{j} SELECT s1, candidate FROM {by('name_jaccard')} WHERE rank <= 2 UNION SELECT s1, candidate FROM {by('address_jaccard')} WHERE rank <= 2",
        "cap_many": f"{caps} SELECT cap, s1, candidate FROM capped",
        "cap_recall": f"""{caps}, e AS (SELECT a.s1, cp.cap, {counted}, (SELECT count(*) FROM j JOIN truth t USING (s1, candidate) WHERE j.s1 = a.s1) AS raw, (SELECT count(*) FROM capped c WHERE c.s1 = a.s1 AND c.cap = cp.cap) AS n, (SELECT count(*) FROM capped c JOIN truth t USING (s1, candidate) WHERE c.s1 = a.s1 AND c.cap = cp.cap) AS hits FROM anchors a CROSS JOIN (VALUES ({CAPS[0]}), ({CAPS[1]})) cp(cap))
            SELECT cap, sum(links)::BIGINT AS links, round(sum(raw) / sum(links), 6) AS raw_recall, round(sum(hits) / sum(links), 6) AS retained_recall, round(count(*) FILTER (links > 0 AND hits = links) / count(*) FILTER (links > 0), 6) AS full_hit_rate, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95 FROM e GROUP BY cap""",
        "wide_sweep": sweep,
        "fold_counters": f"{pin}, e AS (SELECT a.s1, {counted}, (SELECT count(*) FROM pred p WHERE p.s1 = a.s1) AS n, (SELECT count(*) FROM pred p JOIN truth t USING (s1, candidate) WHERE p.s1 = a.s1) AS hits FROM anchors a) SELECT {fold.replace('{x}', "s1 || 'fold'")} AS fold, count(*) AS anchors, sum(links)::BIGINT AS links, sum(hits)::BIGINT AS recalled, sum(n)::BIGINT AS candidates FROM e GROUP BY 1",
        "other_neighbours": f"{state} SELECT s1, candidate, row_number() OVER (PARTITION BY s1 ORDER BY rank) AS place FROM ranked ANTI JOIN truth USING (s1, candidate) QUALIFY place <= 3",
        "filled_neighbours": f"{state} SELECT o.s1, o.candidate, c.business_name, c.country FROM (SELECT s1, candidate FROM ranked ANTI JOIN truth USING (s1, candidate) QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY rank) <= 3) o JOIN keys c ON c.entity_id = o.candidate",
        "top_scores": f"{j}, r AS (SELECT * FROM {by('name_jaccard')}) SELECT a.s1, max(r.score) FILTER (r.rank = 1) AS top, round(max((r.score + r.address_jaccard) / 2), 6) AS best_combined, round(max(r.score) FILTER (r.rank = 1) - max(r.score) FILTER (r.rank = 2), 6) AS gap FROM anchors a LEFT JOIN r ON r.s1 = a.s1 AND r.rank <= 10 GROUP BY 1",
        "label_stats": f"{labelled} SELECT label, {stats} FROM lab GROUP BY 1",
        "wanted_truth": f"{k} SELECT a.s1, coalesce((SELECT string_agg(candidate, ',' ORDER BY candidate) FROM truth t WHERE t.s1 = a.s1), '') AS matched FROM anchors a WHERE {fold.replace('{x}', "s1 || 'fold'")} = 'validation'",
        "linked_records": f"{k} SELECT t.candidate, t.s1, c.country FROM truth t JOIN keys c ON c.entity_id = t.candidate",
        "source_shapes": rf"""{n} SELECT source, count(*) AS n_rows, {', '.join(f"count(*) FILTER (trim({x}) = '') AS missing_{x}" for x in ('entity_id', 'business_name', 'business_address', 'country'))}, count(*) FILTER (regexp_matches(business_address, '(^|[^0-9])[0-9]{{5}}(-[0-9]{{4}})?([^0-9]|$)')) AS five_digit, count(*) FILTER (regexp_matches(business_address, '(^|[^0-9])[1-9][0-9]{{5}}([^0-9]|$)')) AS six_digit,
            count(*) FILTER (regexp_matches(business_address, '(?i)\b[A-Z0-9][A-Z0-9 -]{{2,9}}\b')) AS alphanumeric, count(*) FILTER (contains(business_address, ',')) AS segments_2, count(*) FILTER (business_address LIKE '%,%,%') AS segments_3, sum(len(regexp_extract_all(business_name, '\S+')))::BIGINT AS name_words FROM base GROUP BY 1""",
        "common_names": f"{n} SELECT name_n, count(*) AS n FROM base GROUP BY 1 ORDER BY n DESC, name_n LIMIT 20",
        "name_duplicate_rate": f"{n} SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM base GROUP BY name_n)",
        "malformed_ids": f"{n}, i AS (SELECT CASE WHEN length(business_address) = 0 THEN 'x' || entity_id ELSE entity_id END AS entity_id FROM base UNION ALL SELECT entity_id FROM base WHERE source = 'S3') SELECT entity_id, count(*) AS n, NOT regexp_full_match(entity_id, 'S[123]-[0-9]+') AS bad FROM i GROUP BY 1 HAVING count(*) > 1 OR bad",
        "distinct_ids": f"{n} SELECT 'N-' || split_part(entity_id, '-', 2) AS entity_id, business_name, country FROM base QUALIFY row_number() OVER (PARTITION BY split_part(base.entity_id, '-', 2) ORDER BY business_name, country) = 1",
        "drawn_records": f"{n} SELECT entity_id FROM base ORDER BY {crc("(entity_id || '|2026')")}, entity_id LIMIT 20",
        "record_page": f"{n} SELECT entity_id FROM base ORDER BY entity_id LIMIT 50 OFFSET 50",
        "head_rows": f"{n} SELECT entity_id, business_name FROM base ORDER BY entity_id LIMIT 3",
        "weakest_links": f"{labelled} SELECT s1, candidate, name_jaccard FROM lab WHERE label = 'true' ORDER BY name_jaccard, s1, candidate LIMIT 15",
        "score_histogram_2d": f"{j} SELECT floor(name_jaccard / 1.01 * 25)::BIGINT + 1 AS x_bin, floor(address_jaccard / 1.01 * 25)::BIGINT + 1 AS y_bin, count(*) AS n, round(log10(count(*)), 6) AS log10_n FROM j GROUP BY ALL",
        "truth_sources": f"{k}, o AS (SELECT a.s1, count(t.s1) AS links, count(*) FILTER (t.candidate LIKE 'S2-%') AS n2, count(*) FILTER (t.candidate LIKE 'S3-%') AS n3 FROM anchors a LEFT JOIN truth t ON t.s1 = a.s1 GROUP BY 1) SELECT CASE WHEN links = 0 THEN 'none' WHEN n2 + n3 < links THEN 'unexpected' WHEN n2 > 0 AND n3 > 0 THEN 'both' WHEN n2 > 0 THEN 'S2_only' ELSE 'S3_only' END AS kind, count(*) AS anchors, sum(links)::BIGINT AS links FROM o GROUP BY 1",
        "eda_features": f"{k}, x AS (SELECT t.s1, t.candidate, a.name_n AS an, b.name_n AS bn, a.addr_n AS aa, b.addr_n AS ba, a.country AS ac, b.country AS bc, {num('a.addr_n')} AS na, {num('b.addr_n')} AS nb FROM truth t JOIN keys a ON a.entity_id = t.s1 JOIN keys b ON b.entity_id = t.candidate) SELECT s1, candidate, {', '.join(f'round(({v})::DOUBLE, 6) AS {c}' for c, v in eda.items())} FROM x",
        "row_cosines": f"{k}, {cosines} SELECT t.s1, t.candidate, {', '.join(f'round(coalesce(c_{x}.w, 0), 6) AS {y}' for x, y in (('nc', 'name_char'), ('nw', 'name_word'), ('ac', 'address_char')))} FROM truth t LEFT JOIN c_nc USING (s1, candidate) LEFT JOIN c_nw USING (s1, candidate) LEFT JOIN c_ac USING (s1, candidate)",
        "aligned_lists": lists,
        "zipped_ids": f"SELECT position, source1_entity_id AS id FROM ({lists})",
    }
