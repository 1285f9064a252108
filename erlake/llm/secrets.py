"""Secret scans: all rules compiled into one minimal deterministic automaton, one transition for each byte of text.

The combined automaton tells in one pass which rules match in which lane (a piece of about 1 KB between bytes that no
match can hold). In the lanes where a rule matches, that rule's own automaton, started at each place where a match may
begin, gives leftmost longest spans that don't overlap within the rule. A rule may demand a length of its value: the
part after the longest match of its ``head``.

Defined cases: null and empty texts have no spans; a null doc_id is kept; rows are judged one by one, so repeated rows
repeat; an empty table gives an empty result; of ``df`` only doc_id and text are read by ``find_secrets``, and
``redact`` leaves all other columns as they are. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .automaton import Automaton, Rule, lanes, scan


@dataclass(frozen=True)
class Secret:
    """A kind, its expression, whether case matters, and for values of at least ``least`` characters the head before them."""

    kind: str
    pattern: str
    icase: bool = False
    head: str = ""
    least: int = 0


_HEAD = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: The first three are the base rules. Lengths are tested after the match: a counted repeat multiplies the automaton's
#: states with those of every other rule, so only hex digits, which every text has runs of, are counted in it (a run too
#: short holds no longer one).
RULES = (
    Secret("assign", _HEAD + r"[A-Za-z0-9+/_.=\-]+", True, _HEAD, 6),
    Secret("access", r"AKIA[A-Z0-9]+", head="AKIA", least=16),
    Secret("hex", r"[0-9a-f]{24,}"),
    Secret("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Secret("code_host", r"gh[pousr]_[A-Za-z0-9]+", head=r"gh[pousr]_", least=36),
    Secret("chat_token", r"xox[abprs]-[A-Za-z0-9\-]+", head=r"xox[abprs]-", least=10),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<kind:string,start:int,end:int>>"


@functools.lru_cache
def compiled(rules: tuple[Secret, ...]) -> tuple[Automaton, list[Automaton], list[Automaton | None], list[np.ndarray]]:
    """The combined automaton, each rule's own, its head's, and the byte classes (as bytes) that a match can begin with."""
    every = Automaton([Rule(r.pattern, r.icase) for r in rules], search=True)
    own = [Automaton([Rule(r.pattern, r.icase)], search=False) for r in rules]
    heads = [Automaton([Rule(r.head, r.icase)], search=False) if r.head else None for r in rules]
    begins = [(a.next[a.start] != a.dead)[a.of] for a in own]
    return every, own, heads, begins


def spans_of(part: np.ndarray, at: np.ndarray, rules: tuple[Secret, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """By document: (start byte, rule, end byte), in order."""
    every, own, heads, begins = compiled(rules)
    starts, ends = lanes(part, at, every.resets)
    hit = scan(every, part, starts, ends)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k in np.flatnonzero(hit).tolist():
        s, e = int(starts[k]), int(ends[k])
        doc = int(np.searchsorted(at, s, "right")) - 1
        for r, rule in enumerate(rules):
            if not hit[k] >> r & 1:
                continue
            auto, head = own[r], heads[r]
            classes = auto.of[part[s:e]].tobytes()
            head_classes = head.of[part[s:e]].tobytes() if head else b""
            done = 0
            for i in np.flatnonzero(begins[r][part[s:e]]).tolist():
                if i < done or (end := auto.longest(classes, i, e - s)) < 0:
                    continue
                done = end
                if rule.least and end - head.longest(head_classes, i, end) < rule.least:
                    continue
                out.setdefault(doc, []).append((s + i, r, s + end))
    for x in out.values():
        x.sort()
    return out


def _in_batches(texts: pa.Array, rules: tuple[Secret, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in code points."""
    data, at = c.byte_parts(texts)
    out: list[list] = [[] for _ in range(len(at) - 1)]
    for i, j in c.steps(at):
        part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        for k, spans in spans_of(part, own, rules).items():
            text = part[own[k] : own[k + 1]]
            point = np.zeros(len(text) + 1, np.int64)
            np.cumsum((text & 0xC0) != 0x80, out=point[1:])
            out[i + k] = [(int(point[s - own[k]]), r, int(point[e - own[k]])) for s, r, e in spans]
    return out


def find_secrets(df: DataFrame, rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """doc_id and its spans (kind, start, end) by start, then in the rules' order."""
    kinds = [r.kind for r in rules]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in x] for x in _in_batches(b.column(1), rules)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return c.documents(df).mapInArrow(emit, f"doc_id long, spans {SPAN}")


def redact(df: DataFrame, rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """``df`` with every span in ``text`` replaced by ``<kind>``; spans that overlap are replaced as one, by the first's kind."""
    kinds = [r.kind for r in rules]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    col = df.columns.index("text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(col)
            found = _in_batches(texts.fill_null(""), rules)
            new = [(k, x) for k, x in enumerate(found) if x]
            if new:
                values = texts.to_pylist()
                for k, spans in new:
                    out, done = [], 0
                    for s, r, e in spans:
                        if s >= done:
                            out += [values[k][done:s], f"<{kinds[r]}>"]
                        done = max(done, e)
                    values[k] = "".join(out) + values[k][done:]
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == col else x for i, x in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(emit, schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(c.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """doc_id, the base counts and digest by Python's ``re``."""
    import re

    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for d, t in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        digest = c.sha256(",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in sorted(found)).encode())
        out.append((d, *(sum(k == x for _, k, _ in found) for x in range(3)), digest))
    return out
