"""DuckDB SQL for the same results: common table expressions that the queries' statements start from."""

from __future__ import annotations

from ..functions.text import ADDRESS_STOP, COUNTRY, LEGAL, NAME_STOP, STATES, STREET
from ..sources.records import RECORDS_SQL


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(x: str, words: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items()) + f" ELSE {x} END"


def tokens(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda z: z <> '')"


def norm(x: str, name: bool = False) -> str:
    return f"array_to_string(list_transform({tokens(x)}, lambda z: {_case('z', LEGAL if name else STREET)}), ' ')"


def longest(x: str, keep: str, limit: int) -> str:
    """The longest distinct tokens of a normal text that pass, ties by value."""
    return f"list_transform(list_sort(list_transform(list_filter(list_distinct(string_split({x}, ' ')), lambda z: z <> '' AND ({keep})), lambda z: {{'n': -length(z), 'z': z}})), lambda s: s.z)[1:{limit}]"


RECORDS = RECORDS_SQL.replace("{div}", "//")
_DIGITS = r"regexp_full_match(z, '\p{Nd}+')"
NORMAL = f"""records AS ({RECORDS}), normal AS (SELECT *, split_part(entity_id, '-', 1) AS source, {norm("business_name", True)} AS name_n, {norm("business_address")} AS addr_n, {norm("country")} AS c0 FROM records),
base AS (SELECT *, {_case("c0", COUNTRY)} AS country_key FROM normal)"""
KEYS = rf"""{NORMAL}, tok AS (SELECT *,
  {longest("name_n", f"length(z) >= 3 AND z NOT IN ({_in(NAME_STOP)}) AND NOT {_DIGITS}", 4)} AS name_tokens,
  {longest("addr_n", f"length(z) >= 4 AND z NOT IN ({_in(ADDRESS_STOP)}) AND NOT {_DIGITS}", 4)} AS address_tokens,
  {longest("addr_n", f"length(z) >= 2 AND {_DIGITS}", 2)} AS numbers FROM base),
gr AS (SELECT *, list_sort(list_distinct(list_transform(range(1, greatest(length(name_tokens[1]) - 1, 2)), lambda i: substring(name_tokens[1], i, 3)))) AS ng, list_sort(list_distinct(list_transform(range(1, greatest(length(address_tokens[1]) - 1, 2)), lambda i: substring(address_tokens[1], i, 3)))) AS ag FROM tok),
post AS (SELECT *, CASE WHEN country_key = 'india' THEN list_filter(regexp_extract_all(business_address, '[0-9]+'), lambda z: length(z) = 6 AND z[1] <> '0')[-1]
    WHEN country_key IN ('us', 'france') THEN list_filter(regexp_extract_all(business_address, '[A-Za-z0-9]+'), lambda z: regexp_full_match(z, '[0-9]{{5}}'))[-1]
    ELSE list_transform(regexp_extract_all(regexp_replace(upper(replace(business_address, 'ß', 'ss')), '([^A-Z0-9])', '\1\1', 'g'), '(?:^|[^A-Z0-9])([A-Z0-9]{{3,10}}(?:(?:  |--)[A-Z0-9]{{2,10}})?)(?:[^A-Z0-9]|$)', 1), lambda z: CASE WHEN regexp_matches(z, '[0-9]') THEN z ELSE '' END)[-1] END AS raw_postal FROM gr),
parts AS (SELECT *, regexp_replace(coalesce(raw_postal, ''), '[^A-Z0-9]', '', 'g') AS postal, list_filter(list_transform(string_split(business_address, ','), lambda p: {norm("p")}), lambda p: p <> '') AS all_parts FROM post),
geo AS (SELECT *, list_filter(all_parts, lambda p: postal = '' OR regexp_replace(upper(p), '[^A-Z0-9]', '', 'g') <> postal) AS g FROM parts),
us AS (SELECT *, list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: list_transform(list_filter(string_split(upper(g[i]), ' '), lambda w: w IN ({_in(STATES)})), lambda w: {{'i': i, 'code': lower(w)}}))), lambda s: true)[1] AS f FROM geo),
keys AS (SELECT entity_id, source, business_name, business_address, country, name_n, addr_n, country_key, name_tokens, address_tokens, numbers,
  CASE WHEN len(name_tokens) = 0 THEN [] WHEN len(ng) <= 3 THEN ng ELSE [ng[1], ng[(len(ng) - 1) // 2 + 1], ng[-1]] END AS name_grams,
  CASE WHEN len(address_tokens) = 0 THEN [] WHEN len(ag) <= 3 THEN ag ELSE [ag[1], ag[(len(ag) - 1) // 2 + 1], ag[-1]] END AS address_grams,
  CASE WHEN country_key = 'us' THEN coalesce(f.code, '') WHEN country_key = 'india' THEN coalesce(g[-1], '') WHEN country_key = 'france' THEN '' WHEN len(g) >= 3 THEN g[-1] ELSE '' END AS state, postal,
  CASE WHEN country_key = 'us' THEN coalesce(CASE WHEN f.i > 1 THEN g[f.i - 1] WHEN f.i = 1 THEN g[2] END, '') WHEN country_key = 'india' THEN coalesce(g[-2], '') WHEN country_key = 'france' THEN coalesce(g[-1], '') WHEN len(g) >= 3 THEN g[-2] WHEN len(g) = 2 THEN g[-1] ELSE '' END AS city FROM us)"""
_NAME, _ADDR = "coalesce(name_tokens[1], '')", "coalesce(address_tokens[1], '')"


def _blocks(source: str, anchors: bool, routes: tuple[str, ...]) -> str:
    """SELECTs of (entity_id, source, route, slot, key) for one side; every demonstration record has a country."""
    rows = [("country_state_pin", "", ["state", "postal"]), ("country_state_name", "", ["state", _NAME]), ("country_pin_name", "", ["postal", _NAME]), ("country_city_name", "", ["city", _NAME]), ("country_rare_name", "", [_NAME]), ("country_address_token", "", [_ADDR])]
    for slot in ("number1", "number2"):
        rows += [("country_numeric", slot, [f"coalesce(numbers[{i}], '')"]) for i in ((1, 2) if anchors else ((1,) if slot == "number1" else (2,)))]
    for i in (1, 2, 3):
        rows += [("approximate_name", f"gram{i}", [f"coalesce(name_grams[{i}], '')"]), ("approximate_address", f"gram{i}", [f"coalesce(address_grams[{i}], '')"])]
    one = [f"SELECT entity_id, source, '{r}' AS route, '{s}' AS slot, concat_ws('|', country_key, {', '.join(p)}) AS key FROM keys WHERE {source} AND country_key <> '' AND {' AND '.join(f'{x} <> {chr(39)}{chr(39)}' for x in p)}" for r, s, p in rows if r in routes]
    many = [f"SELECT entity_id, source, '{r}' AS route, '' AS slot, concat_ws('|', country_key, unnest({x})) AS key FROM keys WHERE {source} AND country_key <> ''" for r, x in (("country_multi_name_token", "name_tokens"), ("country_multi_address_token", "address_tokens")) if r in routes]
    return " UNION ALL ".join(one + many)


CORE = ("country_state_pin", "country_state_name", "country_pin_name", "country_city_name", "country_rare_name", "country_multi_name_token")


def pairs(per_key: int, routes: tuple[str, ...]) -> str:
    """``pairs`` (s1, candidate, route) of the routes, and of the core routes where an approximate one needs them."""
    wanted = (*routes, *(CORE if any(r.startswith("approximate") for r in routes) else ()))
    keys = KEYS.replace("keys AS (SELECT", "keys AS MATERIALIZED (SELECT")
    return f"""{keys}, ak AS MATERIALIZED ({_blocks("source = 'S1'", True, wanted)}), ck AS MATERIALIZED (SELECT * FROM ({_blocks("source <> 'S1'", False, wanted)}) QUALIFY row_number() OVER (PARTITION BY route, slot, key, source ORDER BY entity_id) <= {per_key}),
raw AS MATERIALIZED (SELECT DISTINCT a.entity_id AS s1, c.entity_id AS candidate, a.route FROM ak a JOIN ck c ON a.route = c.route AND a.slot = c.slot AND a.key = c.key),
enough AS (SELECT s1 FROM raw WHERE route IN ({_in(list(CORE))}) GROUP BY s1 HAVING count(DISTINCT candidate) >= 20),
pairs AS MATERIALIZED (SELECT * FROM raw WHERE route NOT LIKE 'approximate%' OR s1 NOT IN (SELECT s1 FROM enough))"""


def char_grams(x: str, low: int, high: int) -> str:
    return "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length({x}) - {n} + 2, 1)), lambda i: substring({x}, i, {n}))" for n in range(low, high + 1)) + ")"


def one_byte(x: str) -> str:
    """DuckDB measures edit distances in bytes, so each letter beyond ASCII is mapped to a byte that the texts don't hold."""
    letters = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüàâîôùûëïœáúÀÂÎÔÙÛËÁÚ"
    free = [chr(i) for i in (*range(1, 9), *range(14, 32), 127)] + list("^~`{}[]<>?;:_\\")
    return f"translate({x}, '{letters}', '{''.join(free[: len(letters)])}')"


TRUTH = "truth AS (SELECT a.entity_id AS s1, b.entity_id AS candidate FROM keys a JOIN keys b ON a.source = 'S1' AND b.source <> 'S1' AND split_part(a.entity_id, '-', 2) = split_part(b.entity_id, '-', 2))"
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda q, k: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)), 4294967295)"
