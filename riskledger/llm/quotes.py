"""Conversations from quoting messages, with DataFrame functions only.

A line's quote level is the number of ``>`` marks before it. Runs of lines of one level are
passages; a passage is normalised (letters and digits in lower case, the rest single spaces, so
wrapping and marks do not matter) and hashed. A message offers its own text as a whole, by
paragraph and by line; a quoted passage is looked up the same way among the earlier messages of its
conversation, and the latest message that holds it is the one it quotes. The parent of a message is
the one with the most characters quoted at the lowest level. Replies follow what they answer, and
the text left is the message's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskledger.llm.frames import checkpointed
from riskledger.operators.ranks import global_position

MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: A line that only introduces a quote, when a quoted line follows it.
INTRODUCES = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|.{1,80}\b(wrote|said|writes))\s*:?\s*$"
#: Turns in one cell of the search for the latest earlier message.
CELL = 4096


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines of a text."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("body"))

    return F.transform(F.split(text, "\r?\n", -1), line)


def own_text(parsed: Column) -> Column:
    """Lines of level 0 without those that only introduce a quote; blank edges go."""

    def kept(x: Column, i: Column) -> Column:
        following = F.get(parsed, i + 1)["level"]
        return (x["level"] == 0) & ~(x["body"].rlike(INTRODUCES) & (F.coalesce(following, F.lit(0)) > 0))

    lines = F.transform(F.filter(parsed, kept), lambda x: x["body"])
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def quoted_passages(parsed: Column) -> Column:
    """array<struct<level, body>>: runs of quoted lines of one level; own text or a blank quoted line ends a run."""
    none = F.array().cast("array<struct<level:int,body:string>>")

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        goes_on = (F.size(done) > 0) & (last["level"] == x["level"]) & (x["level"] > 0) & (F.trim(x["body"]) != "") & (F.trim(last["body"]) != "")
        longer = F.struct(x["level"].alias("level"), F.concat(last["body"], F.lit("\n"), x["body"]).alias("body"))
        fresh = F.struct(x["level"].alias("level"), F.when(x["level"] > 0, x["body"]).otherwise("").alias("body"))
        apart = (x["level"] == 0) & (F.size(done) > 0) & (last["level"] == 0)  # own text leaves one mark, however long it is
        return F.when(apart, done).when(goes_on, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(fresh)))

    return F.filter(F.aggregate(parsed, none, step), lambda x: (x["level"] > 0) & (F.trim(x["body"]) != ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _offers(own: Column) -> Column:
    """The whole text, its paragraphs and its lines, normalised."""
    parts = F.concat(F.array(own), F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1))
    return F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != ""))


def _latest_earlier(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """wanted (conv, hash, turn) with source: the latest turn before it that offers the hash.

    Inside a cell of turns by a running maximum, and over the cells before it by one of the cells'
    own, so a passage that a long conversation repeats is not one task's.
    """
    keys = ["conv", "hash"]
    # only what is asked for; read twice below, so it is stored
    offered = checkpointed(offered.join(wanted.select(*keys).distinct(), keys, "left_semi").distinct())
    both = offered.select(*keys, "turn", F.col("turn").alias("has")).union(wanted.select(*keys, "turn", F.lit(None).cast("long")).distinct())
    both = both.withColumn("cell", F.floor(F.col("turn") / CELL))
    inside = Window.partitionBy(*keys, "cell").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy(*keys, "cell").agg(F.max("has").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "cell", F.max("top").over(earlier).alias("before"))
    found = both.withColumn("source", F.max("has").over(inside)).where("has is null").join(cells, [*keys, "cell"])
    return found.select(*keys, "turn", F.coalesce("source", "before").alias("source")).where("source is not null")


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From conv, turn, parsed, own: links (conv, turn, parent) and quotes (conv, turn, quoted, found)."""
    passages = messages.where(F.exists("parsed", lambda x: x["level"] > 0)).select("conv", "turn", F.posexplode(quoted_passages(F.col("parsed"))).alias("place", "p"))
    # a passage is looked up as a whole and, if that fails, by its lines
    pieces = passages.select("conv", "turn", "place", F.col("p.level").alias("level"), F.explode(_offers(F.col("p.body"))).alias("piece"))
    pieces = checkpointed(pieces.withColumn("hash", F.xxhash64("piece")).withColumn("size", F.length("piece")).drop("piece"))
    offered = messages.select("conv", "turn", F.explode(F.transform(_offers(F.col("own")), lambda x: F.xxhash64(x))).alias("hash"))
    sources = _latest_earlier(pieces.select("conv", "hash", "turn"), offered)
    found = checkpointed(pieces.join(sources, ["conv", "hash", "turn"]))
    votes = found.groupBy("conv", "turn", "level", "source").agg(F.sum("size").alias("size"))
    order = F.struct(-F.col("level"), "size", "source")
    links = votes.groupBy("conv", "turn").agg(F.max_by("source", order).alias("parent"))
    counted = pieces.select("conv", "turn", "place").distinct().groupBy("conv", "turn").agg(F.count("*").alias("quoted"))
    matched = found.select("conv", "turn", "place").distinct().groupBy("conv", "turn").agg(F.count("*").alias("found"))
    return links, counted.join(matched, ["conv", "turn"], "left")


def _roots(links: DataFrame) -> DataFrame:
    """conv, turn, parent, root, depth: pointers are doubled until all end at a root."""
    now = checkpointed(links.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        step = now.select(F.col("conv"), F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = now.join(step, ["conv", "root"], "left")
        moved = joined.select("conv", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        now = checkpointed(moved)
        if now.where("moved").isEmpty():
            return now.drop("moved")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message in reply order.

    conv, turn, role, text (its own, without quotes), parent (turn of the message it quotes, or null), root
    and depth of its thread, quoted and found (passages), position (from 0 in the conversation: threads by
    the turn of their root, and by turn inside). Messages without a link are roots. Turns must be integers. A
    null conversation is one of its own; a null turn comes last and neither quotes nor is quoted; a null text is
    empty; repeated rows are numbered one after another; other columns are not read; an empty table gives
    an empty result.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("parsed", parsed_lines(F.col("text"))).withColumn("own", own_text(F.col("parsed")))
    known = rows.where("conv is not null and turn is not null")
    links, quotes = link(known.select("conv", "turn", "parsed", "own"))
    rooted = _roots(links)
    plain = rows.select("conv", "turn", "role", F.col("own").alias("text"))
    joined = plain.join(rooted, ["conv", "turn"], "left").join(quotes, ["conv", "turn"], "left")
    joined = joined.withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long")), "quoted": F.coalesce("quoted", F.lit(0).cast("long")), "found": F.coalesce("found", F.lit(0).cast("long"))})
    order = [F.col("conv").asc_nulls_first(), F.col("root").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text")]
    placed = checkpointed(global_position(joined, order, "place"))
    first = placed.groupBy("conv").agg(F.min("place").alias("first")).withColumnRenamed("conv", "of")
    numbered = placed.join(first, F.col("conv").eqNullSafe(F.col("of")))
    return numbered.select("conv", "turn", "role", "text", "parent", "root", "depth", "quoted", "found", (F.col("place") - F.col("first")).alias("position"))


def chat_lines(ordered: DataFrame) -> DataFrame:
    """Messages as chat-format JSON lines: conv, position, line; own text only, empty messages left out."""
    said = F.to_json(F.struct("role", F.col("text").alias("content")))
    return ordered.where("text <> ''").select("conv", "position", said.alias("line"))
