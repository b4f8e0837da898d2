"""Quotation linking: who answers whom, read from the passages that messages quote.

A line that begins with ``>`` marks is quoted, as deep as it has marks.  Lines of one depth that follow
each other, up to a blank line, are a passage; a message's unquoted passages are its own words.
Passages are normalised (white space runs become one space, lower case) and hashed to 128 bits.  A
quoted passage is linked to the latest earlier message of its conversation that has the passage among
its own words.  A message's parent is the source of its longest passage quoted at depth one; chains of
parents are followed by pointer doubling to the message that began the thread, and messages are
numbered within their thread in order of turn, which puts every message after the one it answers.

The latest earlier source is found in two steps, so that neither a passage nor a conversation that
holds a third of all rows meets in one task: the latest turn per block of ``SPAN`` turns first, then
within a block.  Nothing is paired within a group.

Defined cases: a null text has no passages and is empty; messages with a null conversation or turn
have no links and no position and begin a thread of their own; rows that share conversation and turn
are one message for linking and keep a row each; a quotation that isn't found is counted in
``n_unlinked``; a column of the messages named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, heavy_split_join, pin

SPAN = 1024
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ADDED = ["parent_turn", "root_turn", "depth", "position", "n_quotes", "n_unlinked", "clean_text"]

_PASSAGE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("h1", T.LongType()),
                         T.StructField("h2", T.LongType()), T.StructField("size", T.IntegerType())])


def parse(text: str) -> tuple[list[tuple[int, str]], str]:
    """(passages as (depth, normalised words), the text without quoted lines)."""
    passages: list[tuple[int, list[str]]] = []
    own, level, open_ = [], -1, False
    for line in text.split("\n"):
        mark = MARKS.match(line)
        depth = mark[1].count(">") if mark else 0
        rest = line[mark.end():] if mark else line
        if not mark:
            own.append(line)
        words = rest.lower().split()
        if not words:
            open_ = False
        elif open_ and depth == level:
            passages[-1][1].extend(words)
        else:
            passages.append((depth, words))
            open_ = True
        level = depth
    return [(d, " ".join(ws)) for d, ws in passages], "\n".join(own)


def passage_hash(words: str) -> tuple[int, int]:
    d = hashlib.blake2b(words.encode("utf-8", "replace"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``clean_text`` and ``passages`` (depth, hash and length of each) in place of the text."""
    bounded_batches(messages.sparkSession)
    keep = [c for c in messages.columns if c not in [*ADDED, text_col]]
    schema = T.StructType([messages.schema[c] for c in keep] + [
        T.StructField("clean_text", T.StringType()), T.StructField("passages", T.ArrayType(_PASSAGE))])
    kind = pa.list_(pa.struct([("level", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(t or "") for t in b[text_col].to_pylist()]
            rows = [[dict(zip(("level", "h1", "h2", "size"), (d, *passage_hash(ws), len(ws)))) for d, ws in ps] for ps, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in keep], pa.array([own for _, own in found], pa.string()), pa.array(rows, kind)],
                [*keep, "clean_text", "passages"])

    return messages.select(*[F.col(f"`{c}`") for c in messages.columns]).mapInArrow(work, schema)


def link_passages(passages: DataFrame) -> DataFrame:
    """(conv, turn, level, h1, h2, size, source): each distinct quoted passage with the turn it was taken from."""
    key = ["conv", "h1", "h2"]
    held = passages.groupBy(*key, "turn").agg(
        F.max(F.col("level") == 0).alias("own"), F.min(F.when(F.col("level") > 0, F.col("level"))).alias("level"),
        F.max("size").alias("size")).withColumn("span", F.floor(F.col("turn") / SPAN))
    held = pin(held)
    own_turn = F.when(F.col("own"), F.col("turn"))
    spans = held.groupBy(*key, "span").agg(F.max(own_turn).alias("latest"))
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.max("latest").over(before)).select(*key, "span", "earlier")
    inside = Window.partitionBy(*key, "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = held.withColumn("near", F.max(own_turn).over(inside)).filter(F.col("level").isNotNull())
    return near.join(spans, [*key, "span"]).select(
        "conv", "turn", "level", "h1", "h2", "size", F.coalesce("near", "earlier").alias("source"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of every message of (conv, turn, parent), by pointer doubling.

    The number of rounds grows with the logarithm of the longest chain.
    """
    now = pin(parents.select("conv", "turn", "parent", F.coalesce("parent", "turn").alias("up"),
                             F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
                             F.col("parent").isNull().alias("done")))
    while not now.filter(~F.col("done")).isEmpty():
        asked = now.filter(~F.col("done")).groupBy("conv", "up").agg(F.count(F.lit(1)).alias("n"))
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"),
                           F.col("done").alias("end"))
        above = pin(asked.join(above, ["conv", "up"]))
        moved = heavy_split_join(now.filter(~F.col("done")), above, ["conv", "up"], "n").select(
            "conv", "turn", "parent", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("end").alias("done"))
        now = pin(now.filter("done").unionByName(moved).repartition("conv", "turn"))  # else parts add up by round
    return now.select("conv", "turn", "parent", F.col("up").alias("root"), "depth")


def positions(rows: DataFrame) -> DataFrame:
    """(conv, turn, position): place in the thread in order of turn, from 1, counted by blocks of turns."""
    rows = rows.select("conv", "root", "turn", F.floor(F.col("turn") / SPAN).alias("span"))
    spans = rows.groupBy("conv", "root", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv", "root").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv", "root", "span").orderBy("turn")
    return (rows.withColumn("no", F.row_number().over(inside)).join(spans, ["conv", "root", "span"])
            .select("conv", "turn", (F.col("no") + F.col("earlier")).alias("position")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` without quoted lines (``clean_text`` instead of the text), with their place in the conversation.

    Adds parent_turn, root_turn, depth, position, n_quotes and n_unlinked.
    """
    rows = pin(parsed(messages, text_col))
    keyed = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), "passages")
    keyed = keyed.filter(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    links = pin(link_passages(keyed.select("conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.*")))
    found = links.groupBy("conv", "turn").agg(
        F.max(F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.struct("size", "source"))).alias("best"),
        F.count(F.lit(1)).alias("n_quotes"), F.sum(F.col("source").isNull().cast("bigint")).alias("n_unlinked"))
    each = keyed.select("conv", "turn").distinct().join(found, ["conv", "turn"], "left")
    each = pin(each.select("conv", "turn", F.col("best.source").alias("parent"), "n_quotes", "n_unlinked"))
    placed = threads(each.select("conv", "turn", "parent"))
    place = pin(placed.join(positions(placed), ["conv", "turn"]).join(
        each.select("conv", "turn", "n_quotes", "n_unlinked"), ["conv", "turn"]))
    place = place.withColumnRenamed("turn", "turn_no")
    keep = [c for c in rows.columns if c not in ("clean_text", "passages")]
    joined = rows.join(place, (F.col(f"`{conv_col}`") == F.col("conv")) & (F.col(f"`{turn_col}`") == F.col("turn_no")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep], F.col("parent").alias("parent_turn"),
        F.coalesce(F.col("root"), F.col(f"`{turn_col}`").cast("bigint")).alias("root_turn"),
        F.coalesce(F.col("depth"), F.lit(0)).cast("bigint").alias("depth"), F.col("position").cast("bigint").alias("position"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_unlinked", F.lit(0)).cast("bigint").alias("n_unlinked"), "clean_text")


def as_mail(messages: DataFrame) -> DataFrame:
    """The conversations as mail would hold them: each turn quotes the turn before, and that one's quotation.

    Turn t - 1 stands above the words of turn t with one mark a line, turn t - 2 above it with two.
    """
    earlier = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    quoted = lambda c, mark: F.concat(F.regexp_replace(c, "(?m)^", mark), F.lit("\n"))
    one = earlier.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("one"))
    two = earlier.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("said").alias("two"))
    both = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", "role", F.concat(
        F.coalesce(quoted("two", ">> "), F.lit("")), F.coalesce(quoted("one", "> "), F.lit("")),
        F.coalesce("text", F.lit(""))).alias("text"))
