"""Text normalisation, geography and token keys as column expressions."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alias maps and word lists that results depend on.
LEGAL = {"corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private", "co": "company"}
STREET = {"rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway"}
COUNTRY = {"us": "us", "u s": "us", "usa": "us", "united states": "us", "united states of america": "us"}
NAME_STOP = "and the company co corp corporation inc incorporated limited ltd private pvt llc llp plc services service india traders trading enterprises enterprise group business".split()
ADDRESS_STOP = "road rd street st avenue ave lane ln drive dr near opposite behind floor building block sector plot house number no district county city state india usa".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


_FOLDS = {
    "fold first": lambda v: unicodedata.normalize("NFKC", v.casefold()),
    "nfkc first": lambda v: unicodedata.normalize("NFKC", v).casefold(),
    "casefold": str.casefold,
    "nfkc": lambda v: unicodedata.normalize("NFKC", v),
}


@functools.cache
def _udf(kind: str):
    one = _FOLDS[kind]

    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else one(v))

    # not deterministic only for the optimizer, so that the call stays in its own projection, outside lambdas
    return F.pandas_udf(fold, "string").asNondeterministic()


def folded(x: Column, fold_first: bool = True, kind: str = "") -> Column:
    """Case folding and NFKC, in either order, or one of them (``kind``). JVM-side for ASCII rows; Python gets only the other rows' text.

    Select it as a column of its own before ``normalize`` and the like use it.
    """
    kind = kind or ("fold first" if fold_first else "nfkc first")
    x = F.coalesce(x, F.lit(""))
    ascii_ = ~x.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_, x if kind == "nfkc" else F.lower(x)).otherwise(_udf(kind)(F.when(~ascii_, x)))


def _map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def _tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def normalize(x: Column, name: bool = False) -> Column:
    """Of a folded text: ``&`` as ``and``, letters and digits only, aliases of legal forms (names) or streets (addresses)."""
    aliases = _map(LEGAL if name else STREET)
    t = _tokens(F.replace(x, F.lit("&"), F.lit(" and ")))
    return F.array_join(F.transform(t, lambda w: F.coalesce(aliases[w], w)), " ")


#: Names of the experiment normaliser's steps (fixed values).
OPTIONS = ("casefold", "unicode_nfkc", "punctuation_to_space", "collapse_whitespace")


def normalize_experiment(x: Column, punctuation: bool = True, whitespace: bool = True) -> Column:
    """Of a text folded after NFKC (``folded(x, False)``, or raw to leave that out); no ``&`` rule, no aliases."""
    if punctuation:
        x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " ")) if whitespace else x


def experiment(df: DataFrame, column: str, out: str, **options: bool) -> DataFrame:
    """``df`` with ``column`` normalised as ``out``; any of ``OPTIONS`` may be turned off, other names are an error."""
    if unknown := sorted(set(options) - set(OPTIONS)):
        raise ValueError(f"unknown normalisation options: {unknown}")
    on = dict.fromkeys(OPTIONS, True) | options
    x = F.coalesce(F.col(column), F.lit(""))
    kind = ("casefold",) * on["casefold"] + ("nfkc",) * on["unicode_nfkc"]
    first = {(): x, ("casefold",): folded(x, kind="casefold"), ("nfkc",): folded(x, kind="nfkc")}.get(kind, folded(x, False))
    return df.withColumn("_folded", first).withColumn(out, normalize_experiment(F.col("_folded"), on["punctuation_to_space"], on["collapse_whitespace"])).drop("_folded")


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def numbers(x: Column) -> Column:
    return F.filter(tokens(x), lambda t: t.rlike(r"^\p{Nd}+$"))


def _longest_first(x: Column, limit: int) -> Column:
    keyed = F.array_sort(F.transform(x, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(keyed, lambda s: s["t"]), 1, limit)


def numeric_components(normal_address: Column, limit: int = 2) -> Column:
    return _longest_first(F.filter(numbers(normal_address), lambda t: F.length(t) >= 2), limit)


def informative_tokens(normal: Column, name: bool, limit: int = 4) -> Column:
    stop, least = (NAME_STOP, 3) if name else (ADDRESS_STOP, 4)
    return _longest_first(F.filter(tokens(normal), lambda t: (F.length(t) >= least) & ~t.isin(stop) & ~t.rlike(r"^\p{Nd}+$")), limit)


def approximate_grams(informative: Column) -> Column:
    """First, middle and last of the longest token's distinct sorted trigrams; all, if there are three at most."""
    token = F.coalesce(F.try_element_at(informative, F.lit(1)), F.lit(""))
    all_ = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 2, F.lit(1))), lambda i: F.substring(token, i, F.lit(3)))))
    n = F.size(all_)
    spread = F.array(F.element_at(all_, 1), F.element_at(all_, F.floor((n - 1) / 2).cast("int") + 1), F.element_at(all_, -1))
    return F.when(token == "", F.array().cast("array<string>")).when(n <= 3, all_).otherwise(spread)


def country_key(x: Column) -> Column:
    """Of a folded country label: known variants as one key, others as they are."""
    n = normalize(x)
    return F.coalesce(_map(COUNTRY)[n], n)


def geography(address: Column, folded_address: Column, key: Column) -> Column:
    """Struct (state, postal, city) from the comma parts of an address, by the habits of the country ``key``."""
    address = F.coalesce(address, F.lit(""))
    last = lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(""))
    india = last(F.regexp_extract_all(address, F.lit(r"(?<!\d)[1-9]\d{5}(?!\d)"), F.lit(0)))
    zip_ = last(F.regexp_extract_all(address, F.lit(r"(?<![A-Za-z0-9])\d{5}(?:-\d{4})?(?![A-Za-z0-9])"), F.lit(0)))
    other = last(F.regexp_extract_all(F.upper(address), F.lit(r"(?<![A-Za-z0-9])[A-Z0-9]{3,10}(?:[ -][A-Z0-9]{2,10})?(?![A-Za-z0-9])"), F.lit(0)))
    other = F.when(other.rlike(r"\p{Nd}"), other).otherwise("")
    raw = F.when(key == "india", india).when(key.isin("us", "france"), zip_).otherwise(other)
    postal = F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.replace(folded_address, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N},]+", " "), ","), _piece), lambda p: p != "")
    geo = F.filter(parts, lambda p: (postal == "") | (F.regexp_replace(F.upper(p), "[^A-Z0-9]", "") != postal))
    at = lambda i: F.coalesce(F.when(F.lit(i) != 0, F.try_element_at(geo, F.lit(i))), F.lit(""))
    codes = F.flatten(F.transform(geo, lambda p, i: F.transform(F.filter(F.regexp_extract_all(F.upper(p), F.lit(r"(?U)\b[A-Z]{2}\b"), F.lit(0)), lambda w: w.isin(STATES)), lambda w: F.struct(i.alias("i"), F.lower(w).alias("code")))))
    found = F.try_element_at(codes, F.lit(1))
    near = F.when(found["i"] > 0, found["i"]).otherwise(found["i"] + 2)
    us_city = F.when(found.isNotNull(), F.coalesce(F.try_element_at(geo, near.cast("int")), F.lit(""))).otherwise("")
    n = F.size(geo)
    state = F.when(key == "us", F.coalesce(found["code"], F.lit(""))).when(key == "india", at(-1)).when(key == "france", "").when(n >= 3, at(-1)).otherwise("")
    city = F.when(key == "us", us_city).when(key == "india", at(-2)).when(key == "france", at(-1)).when(n >= 3, at(-2)).when(n == 2, at(-1)).otherwise("")
    return F.struct(state.alias("state"), postal.alias("postal"), city.alias("city"))


def _piece(x: Column) -> Column:
    aliases = _map(STREET)
    return F.array_join(F.transform(F.filter(F.split(x, " "), lambda t: t != ""), lambda w: F.coalesce(aliases[w], w)), " ")


def lookup_keys(normal_name: Column, normal_address: Column) -> Column:
    """Struct of the three short keys: squeezed name prefix, longest name word, number with address word."""
    word = lambda x, stop, least, digits: F.coalesce(F.try_element_at(_longest_first(F.filter(tokens(x), lambda t: (F.length(t) >= least) & ~t.isin(stop) & (F.lit(digits) | ~t.rlike(r"^\p{Nd}+$"))), 1), F.lit(1)), F.lit(""))
    number = F.coalesce(F.try_element_at(_longest_first(numbers(normal_address), 1), F.lit(1)), F.lit(""))
    street = F.substring(word(normal_address, ADDRESS_STOP, 4, False), 1, 8)
    return F.struct(F.substring(F.replace(normal_name, F.lit(" "), F.lit("")), 1, 6).alias("prefix"), F.substring(word(normal_name, NAME_STOP, 3, True), 1, 10).alias("long_token"), F.when((number != "") & (street != ""), F.concat(number, F.lit(":"), street)).otherwise("").alias("address_key"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hash_sample(x: Column, divisor: int) -> Column:
    return F.crc32(x.cast("binary")) % divisor == 0


def hash_sample_64(x: Column, divisor: int) -> Column:
    """The same by a 64-bit hash, for divisors beyond what 32 bits spread well."""
    return F.pmod(F.xxhash64(x), F.lit(divisor).cast("long")) == 0


def fold(x: Column) -> Column:
    k = F.crc32(F.concat(x, F.lit("fold")).cast("binary")) % 10
    return F.when(k == 0, "calibration").when(k == 1, "validation").otherwise("train")
