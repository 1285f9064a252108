"""Chat formatting: quotation linking and reply-ordered conversations without quotes. DataFrame operations only.

A line that starts with ``>`` marks (blanks between them allowed) is quoted at the level of its marks; neighbouring lines
of one level are a passage, and blank lines cut it into paragraphs. Lines, paragraphs and passages are normalised (case,
punctuation, blanks and line breaks) and hashed, and quoted ones are linked to the latest earlier turn of the same conversation
that says the same in its own words, as a line, a paragraph, a passage or as all that it says; so a quote may be wrapped anew.
One ordered pass over each hashed text finds the latest turn, however often it is said and quoted. A message replies to the turn that most characters of its outermost quotes come from (ties: the latest turn);
a message without such a quote opens a thread. ``root_turn`` and ``depth`` come from pointer doubling, so
``(conv_id, root_turn, depth, turn)`` is the reply order: every message after the one it answers.

Defined cases: null texts count as empty; null conv_id or turn: the message is kept, opens a thread and links
nothing; rows that share conv_id and turn are one message for linking, and each is kept; quotes whose original isn't
found stay counted in ``n_quotes`` and are cut all the same; an empty table gives an empty result; ``role`` and other
columns are never read for linking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

_MARKS = r"^[ \t]*(>[> \t]*)"


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Structs (level, body) of the text's lines."""
    marks = lambda x: F.regexp_extract(x, _MARKS, 1)
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(marks(x), r"[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))


def _with_passages(df: DataFrame) -> DataFrame:
    """Adds ``passages``, neighbouring lines of one level joined, and ``paragraphs`` of them, as structs (level, body)."""
    n = F.size("lines")
    level = lambda i: F.element_at("lines", i)["level"]
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    df = df.withColumn("begins", begins)

    def passage(i: Column, k: Column) -> Column:
        more = F.coalesce(F.get("begins", k + 1), n + 1) - i
        return F.struct(level(i).alias("level"), F.array_join(F.transform(F.slice("lines", i, more), lambda x: x["body"]), "\n").alias("body"))

    df = df.withColumn("passages", F.transform("begins", passage))
    cut = lambda p: F.transform(F.split(p["body"], r"\n[ \t\r]*\n"), lambda x: F.struct(p["level"].alias("level"), x.alias("body")))
    return df.withColumn("paragraphs", F.flatten(F.transform("passages", cut))).drop("begins")


def reply_order(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), parent_turn, root_turn, depth, n_quotes, n_linked and max_level of every message."""
    messages = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said")).withColumn("lines", _lines(F.col("said")))
    placed_ = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    hashed = lambda n: [F.xxhash64(n).alias("h1"), F.hash(n).alias("h2")]
    pieces = F.explode(F.array_distinct(F.concat("lines", "paragraphs", "passages"))).alias("p")
    # only texts with a quote mark need their passages for what they quote
    quoting = _with_passages(placed_.where(r"said RLIKE '(^|\\n)[ \\t]*>'"))
    quoted = quoting.select("conv_id", "turn", pieces).where("p.level > 0").select("conv_id", "turn", F.col("p.level").alias("level"), _normal(F.col("p.body")).alias("n")).where("n <> ''")
    quoted = c.stored(quoted.select("conv_id", "turn", "level", *hashed("n"), F.length("n").alias("size")).distinct())
    wanted = quoted.select("conv_id", "h1", "h2").distinct()
    # what is quoted somewhere in the conversation: only such conversations' own words are cut up
    said = _with_passages(placed_.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi"))
    all_ = F.struct(F.lit(0).alias("level"), F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n").alias("body"))
    own = said.select("conv_id", "turn", F.explode(F.array_distinct(F.concat("lines", "paragraphs", "passages", F.array(all_)))).alias("p")).where("p.level = 0")
    own = own.select("conv_id", "turn", _normal(F.col("p.body")).alias("n")).where("n <> ''").select("conv_id", "turn", *hashed("n"))
    own = own.join(wanted, ["conv_id", "h1", "h2"], "left_semi").distinct()
    # one pass in the order of turns: the last turn before that says the same
    both = quoted.withColumn("origin", F.lit(None).cast("long")).unionByName(own.withColumn("origin", F.col("turn")), allowMissingColumns=True)
    before = W.partitionBy("conv_id", "h1", "h2").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    linked = c.stored(both.withColumn("origin", F.last("origin", ignorenulls=True).over(before)).where("level IS NOT NULL AND origin IS NOT NULL").select("conv_id", "turn", "level", "h1", "h2", "size", "origin"))
    level = linked.groupBy("conv_id", "turn").agg(F.min("level").alias("level"), F.count("*").alias("n_linked"))
    parent = linked.join(level, ["conv_id", "turn", "level"]).groupBy("conv_id", "turn", "origin").agg(F.sum("size").alias("size"), F.max("n_linked").alias("n_linked"))
    parent = c.stored(parent.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("size", "origin")).alias("parent_turn"), F.max("n_linked").alias("n_linked")))
    # pointer doubling: far is the ancestor that depth steps lead to
    state = parent.select("conv_id", "turn", F.col("parent_turn").alias("far"), F.lit(1).cast("long").alias("depth"))
    open_ = not parent.isEmpty()
    while open_:
        up = state.select("conv_id", F.col("turn").alias("far"), F.col("far").alias("farther"), F.col("depth").alias("more"))
        state = c.stored(state.join(up, ["conv_id", "far"], "left").select("conv_id", "turn", F.coalesce("farther", "far").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("farther").isNotNull().alias("moved")))
        open_ = not state.where("moved").isEmpty()
        state = state.drop("moved")
    placed = parent.join(state, ["conv_id", "turn"])
    clean = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))
    counted = messages.select("conv_id", "turn", "role", clean.alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"))
    out = counted.join(placed, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("far", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level")


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(c.table(spark, sf_dir, "conversations"))
