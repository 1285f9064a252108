"""Block keys, capped route joins, union, ranking and quotas.

A cap holds per key and source, never per anchor, so it is applied once to the corpus side, before the join: a hot key
contributes at most ``per_key`` rows a source, which bounds the join's output and its skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import text as t

CORE = ("country_state_pin", "country_state_name", "country_pin_name", "country_city_name", "country_rare_name", "country_multi_name_token")
#: Hard negatives of an anchor and source.
NEGATIVES = 6
ROUTES = (*CORE, "country_address_token", "country_numeric", "approximate_name", "approximate_address", "country_multi_address_token")


def with_texts(records: DataFrame) -> DataFrame:
    """(entity_id, source, name_n, addr_n): the normal texts of ``with_keys`` alone."""
    source = F.split_part("entity_id", F.lit("-"), F.lit(1)).alias("source")
    df = records.select("entity_id", source, t.folded(F.col("business_name")).alias("name"), t.folded(F.col("business_address")).alias("address"))
    return df.select("entity_id", "source", t.normalize(F.col("name"), name=True).alias("name_n"), t.normalize(F.col("address")).alias("addr_n"))


def with_keys(records: DataFrame) -> DataFrame:
    """Normalised fields, geography, tokens, numbers and grams of every record."""
    fold = {f"{x}_f": t.folded(F.col(x)) for x in ("business_name", "business_address", "country")}
    df = records.select("entity_id", F.split_part("entity_id", F.lit("-"), F.lit(1)).alias("source"), "business_name", "business_address", "country").withColumns(fold)
    df = df.withColumns({"name_n": t.normalize(F.col("business_name_f"), name=True), "addr_n": t.normalize(F.col("business_address_f")), "country_key": t.country_key(F.col("country_f"))})
    df = df.withColumn("geo", t.geography(F.col("business_address"), F.col("business_address_f"), F.col("country_key"))).drop(*fold)
    df = df.withColumns({"name_tokens": t.informative_tokens(F.col("name_n"), True), "address_tokens": t.informative_tokens(F.col("addr_n"), False), "numbers": t.numeric_components(F.col("addr_n"))})
    df = df.withColumns({"name_grams": t.approximate_grams(F.col("name_tokens")), "address_grams": t.approximate_grams(F.col("address_tokens"))})
    return df.select("*", F.col("geo.state").alias("state"), F.col("geo.postal").alias("postal"), F.col("geo.city").alias("city")).drop("geo")


def _first(x: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(x), F.lit(1)), F.lit(""))


def block_keys(keyed: DataFrame, anchors: bool, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """(entity_id, source, route, slot, key) of the given routes, long form; a key with an empty part forms no block.

    Routes that work without a country have a second slot for it (``*``) on the corpus side; an anchor without country
    uses only that.
    """
    c = F.col("country_key")
    name, addr = _first("name_tokens"), _first("address_tokens")

    def one(route: str, slot: str, parts: list[Column]) -> Column:
        key = F.when(F.forall(F.array(*parts), lambda x: x != ""), F.concat_ws("\u0001", *parts))
        return F.struct(F.lit(route).alias("route"), F.lit(slot).alias("slot"), key.alias("key"))

    def loose(route: str, slot: str, value: Column) -> list[Column]:
        bare = one(route, slot + "*", [value])
        return [one(route, slot, [c, value]), F.when(c == "", bare) if anchors else bare]

    def at(x: str, i: int) -> Column:
        return F.coalesce(F.try_element_at(F.col(x), F.lit(i)), F.lit(""))

    numbers = [("number1", (1, 2) if anchors else (1,)), ("number2", (1, 2) if anchors else (2,))]
    grams = lambda route, x: [k for i in (1, 2, 3) for k in loose(route, f"gram{i}", at(x, i))]
    fixed = {
        "country_state_pin": [one("country_state_pin", "", [c, F.col("state"), F.col("postal")])],
        "country_state_name": [one("country_state_name", "", [c, F.col("state"), name])],
        "country_pin_name": [one("country_pin_name", "", [c, F.col("postal"), name])],
        "country_city_name": [one("country_city_name", "", [c, F.col("city"), name])],
        "country_rare_name": loose("country_rare_name", "", name),
        "country_address_token": loose("country_address_token", "", addr),
        "country_numeric": [k for slot, places in numbers for i in places for k in loose("country_numeric", slot, at("numbers", i))],
        "approximate_name": grams("approximate_name", "name_grams"),
        "approximate_address": grams("approximate_address", "address_grams"),
    }
    tokens = {"country_multi_name_token": "name_tokens", "country_multi_address_token": "address_tokens"}
    of_tokens = lambda route: lambda v: one(route, "", [c, v])
    lists = [F.transform(F.col(tokens[r]), of_tokens(r)) for r in routes if r in tokens]
    keys = [k for r in routes if r in fixed for k in fixed[r]]
    if keys:
        lists.insert(0, F.array(*keys))
    own = ["entity_id", "source", *(["part"] if "part" in keyed.columns else [])]
    found = keyed.select(*own, F.explode(F.concat(*lists)).alias("b"))
    return found.where("b.key IS NOT NULL").select(*own, "b.*")


def capped(keys: DataFrame, per_key: int, by: tuple[str, ...] = ("route", "slot", "key")) -> DataFrame:
    """At most ``per_key`` entities per route, slot, key and source: those with the smallest ids."""
    w = W.partitionBy(*by, "source").orderBy("entity_id")
    return keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_key).drop("_n")


def route_pairs(keyed: DataFrame, per_key: int = 30, routes: tuple[str, ...] = ROUTES, trigger: int = 20) -> DataFrame:
    """(s1, candidate, route), distinct; the approximate routes only for anchors with under ``trigger`` core candidates."""
    if unknown := set(routes) - set(ROUTES):
        raise ValueError(f"unknown routes: {sorted(unknown)}")
    # the approximate routes depend on how many candidates the core routes find; the others stand alone
    triggered = any(r.startswith("approximate") for r in routes)
    wanted = tuple(r for r in ROUTES if r in routes or triggered and r in CORE)
    anchors = block_keys(keyed.where("source = 'S1'"), True, wanted).select(F.col("entity_id").alias("s1"), "route", "slot", "key")
    corpus = capped(block_keys(keyed.where("source <> 'S1'"), False, wanted), per_key).select(F.col("entity_id").alias("candidate"), "route", "slot", "key")
    pairs = anchors.join(corpus, ["route", "slot", "key"]).select("s1", "candidate", "route").distinct()
    if not triggered:
        return pairs
    approximate = F.col("route").startswith("approximate")
    enough = pairs.where(F.col("route").isin(*CORE)).groupBy("s1").agg(F.count_distinct("candidate").alias("n")).where(F.col("n") >= trigger).select("s1")
    return pairs.where(~approximate).union(pairs.where(approximate).join(enough, "s1", "left_anti")).where(F.col("route").isin(*routes))


def union_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1", "candidate").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def paired(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Both records' keys beside each pair, as structs ``a`` and ``b``."""
    cols = F.struct("entity_id", "name_n", "addr_n", "country", "country_key", "state", "postal", "city")
    a = keyed.where("source = 'S1'").select(F.col("entity_id").alias("s1"), cols.alias("a"))
    b = keyed.where("source <> 'S1'").select(F.col("entity_id").alias("candidate"), cols.alias("b"))
    return pairs.join(a, "s1").join(b, "candidate")


def ranked(both: DataFrame) -> DataFrame:
    """Adds ``score`` and ``second``: weighted name and address similarity with bonuses for agreeing geography."""
    name = 100 * F.greatest(k.ratio("a.name_n", "b.name_n"), k.token_set_ratio("a.name_n", "b.name_n"))
    addr = 100 * F.greatest(k.ratio("a.addr_n", "b.addr_n"), k.token_set_ratio("a.addr_n", "b.addr_n"))
    agree = lambda x, w: F.when((F.col(f"a.{x}") != "") & (F.col(f"a.{x}") == F.col(f"b.{x}")), w).otherwise(0)
    both = both.withColumns({"_name": name, "_addr": addr})
    return both.withColumns({"score": 0.58 * F.col("_name") + 0.27 * F.col("_addr") + agree("postal", 18) + agree("state", 8) + agree("city", 5), "second": F.col("_name") + F.col("_addr")}).drop("_name", "_addr")


def quota_caps(scored: DataFrame, limits: list[int]) -> DataFrame:
    """For each of ``limits`` at most that many candidates an anchor, in the column ``cap``: half of it for each source first, the
    rest by rank; small unions stay whole. All limits share two sorts."""
    if not limits or min(limits) < 1:
        raise ValueError("limits must be positive")
    order = [F.desc("score"), F.desc("second"), F.asc("candidate")]
    source = F.split_part("candidate", F.lit("-"), F.lit(1))
    anchor, own = W.partitionBy("s1"), W.partitionBy("s1", source)
    df = scored.withColumns({"_rank": F.row_number().over(own.orderBy(*order)), "_place": F.row_number().over(anchor.orderBy(*order)), "_all": F.count("*").over(anchor)})
    df = df.withColumn("cap", F.explode(F.array(*[F.lit(x) for x in sorted(set(limits))])))
    # those over their source's quota fill what the quotas leave, by rank
    df = df.withColumn("_in", F.col("_rank") <= F.floor(F.col("cap") / 2))
    by_cap = W.partitionBy("s1", "cap")
    df = df.withColumns({"_fixed": F.count_if("_in").over(by_cap), "_late": F.row_number().over(W.partitionBy("s1", "cap", "_in").orderBy("_place"))})
    keep = (F.col("_all") <= F.col("cap")) | F.col("_in") | (F.col("_late") <= F.col("cap") - F.col("_fixed"))
    return df.where(keep).drop("_rank", "_place", "_all", "_in", "_fixed", "_late")


def quota_cap(scored: DataFrame, limit: int) -> DataFrame:
    """``quota_caps`` for one limit."""
    return quota_caps(scored, [limit]).drop("cap")


def hard_negatives(scored: DataFrame, truth: DataFrame, per_source: int = NEGATIVES) -> DataFrame:
    """The best-ranked wrong candidates of each anchor and source; ties go to the larger id."""
    source = F.split_part("candidate", F.lit("-"), F.lit(1))
    w = W.partitionBy("s1", source).orderBy(F.desc("score"), F.desc("second"), F.desc("candidate"))
    return scored.join(truth, ["s1", "candidate"], "left_anti").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).drop("_n")


def features(both: DataFrame) -> DataFrame:
    """The 28 pair features, in order, beside s1 and candidate."""
    c = F.col
    flag = lambda x: x.cast("float")
    ta, tb, da, db = t.tokens(c("a.name_n")), t.tokens(c("b.name_n")), t.tokens(c("a.addr_n")), t.tokens(c("b.addr_n"))
    na, nb = t.numbers(c("a.addr_n")), t.numbers(c("b.addr_n"))
    post = lambda x: F.filter(x, lambda v: F.length(v).between(5, 6))
    some = lambda x: F.size(x) > 0
    common = some(F.array_intersect(na, nb))
    agree = lambda x: flag((c(f"a.{x}") != "") & (c(f"a.{x}") == c(f"b.{x}")))
    clash = lambda x: flag((c(f"a.{x}") != "") & (c(f"b.{x}") != "") & (c(f"a.{x}") != c(f"b.{x}")))
    cols = {
        "name_ratio": k.ratio("a.name_n", "b.name_n"), "name_token_ratio": k.token_set_ratio("a.name_n", "b.name_n"), "name_jaro": k.jaro_winkler_similarity("a.name_n", "b.name_n"), "name_jaccard": t.jaccard(ta, tb),
        "address_ratio": k.ratio("a.addr_n", "b.addr_n"), "address_token_ratio": k.token_set_ratio("a.addr_n", "b.addr_n"), "address_jaccard": t.jaccard(da, db), "number_jaccard": t.jaccard(na, nb),
        "number_agreement": flag(common), "number_conflict": flag(some(na) & some(nb) & ~common), "name_length_ratio": t.length_ratio(c("a.name_n"), c("b.name_n")), "address_length_ratio": t.length_ratio(c("a.addr_n"), c("b.addr_n")),
        "name_exact": agree("name_n"), "address_exact": agree("addr_n"), "country_agreement": flag((c("a.country") != "") & (c("a.country_key") == c("b.country_key"))), "candidate_is_s3": flag(c("candidate").startswith("S3-")),
        "name_missing": flag((c("a.name_n") == "") | (c("b.name_n") == "")), "address_missing": flag((c("a.addr_n") == "") | (c("b.addr_n") == "")), "shared_postal_like": flag(some(F.array_intersect(post(na), post(nb)))),
        "state_agreement": agree("state"), "postal_agreement": agree("postal"), "city_agreement": agree("city"), "name_token_overlap": t.jaccard(ta, tb), "address_token_overlap": t.jaccard(da, db),
        "country_conflict": flag((c("a.country") != "") & (c("b.country") != "") & (c("a.country_key") != c("b.country_key"))), "state_conflict": clash("state"), "postal_conflict": clash("postal"), "city_conflict": clash("city"),
    }
    return both.select("s1", "candidate", *[v.cast("float").alias(n) for n, v in cols.items()])


def union_best(frames: list[DataFrame]) -> DataFrame:
    """Several blockers' candidates, the best score of each pair; ties go to the last method by name."""
    if not frames:
        return SparkSession.active().createDataFrame([], "s1 string, candidate string, score double, method string")
    df = frames[0]
    for x in frames[1:]:
        df = df.unionByName(x)
    best = df.groupBy("s1", "candidate").agg(F.max(F.struct("score", F.col("method"))).alias("m"))
    return best.select("s1", "candidate", "m.score", "m.method")
