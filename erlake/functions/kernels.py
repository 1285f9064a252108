"""String similarities that Spark lacks, as Arrow batches: Indel ratio, token-set ratio, Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bit vectors as long integers."""
    if not a or not b:
        return 0
    mask: dict[str, int] = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & mask.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, da, db = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 1.0
    gap = 1 if both else 0
    la, lb = len(both) + gap + len(da), len(both) + gap + len(db)
    rest = len(da) + len(db) - 2 * lcs(da, db)
    best = 1 - rest / (la + lb)
    if both:
        best = max(best, 1 - (gap + len(da)) / (len(both) + la), 1 - (gap + len(db)) / (len(both) + lb))
    return best


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (b[j] for j in range(len(b)) if used[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _batched(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for k in zip(a.fillna(""), b.fillna("")):
            if k not in seen:
                seen[k] = f(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return lambda a, b: F.pandas_udf(run, "double")(a, b)  # made when called: a session must exist by then


ratio, token_set_ratio, jaro_winkler_similarity = _batched(indel), _batched(token_set), _batched(jaro_winkler)
