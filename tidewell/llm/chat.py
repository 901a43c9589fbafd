"""Quotation linking: from messages that quote each other to reply-ordered conversations.

Lines are parsed into quote levels (a line's leading ``>`` marks).  Every quoted
passage, that is a run of lines of one level without a blank line, is normalised
and hashed, whole and line by line; so is what each message says itself.  A
quoted passage is linked to the latest earlier message of the conversation that
said it.  Quoted text that no earlier message holds stays in the text, with its
marks.  A message replies to the one from which it quotes most at its shallowest
linked level.  Conversations come out without quotes of each other, a row per message, ordered
by ``thread`` (the turn its chain of replies starts from) and ``turn``: a message
always follows the one it replies to.

DataFrame functions throughout.  No step gathers a conversation: links are found
by (conversation, passage), threads by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed, stored

#: Turns that one window looks back over; what lies before is carried over as one row per range.
RANGE_TURNS = 1024
_MARKS = r"^(?:[ \t]*>)+"


def quote_lines(text: Column) -> Column:
    """Lines as array<struct<level, line, norm>>; ``norm`` is without marks, in lower case with single spaces."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        raw = F.regexp_replace(x, _MARKS + " ?", "")
        return F.struct(
            F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
            x.alias("line"),
            F.trim(F.regexp_replace(F.lower(raw), r"\s+", " ")).alias("norm"),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), line)


def _parsed(messages: DataFrame) -> DataFrame:
    """Add ``lines``, the passages and their units."""
    df = messages.withColumn("lines", quote_lines(F.col("text")))
    n = F.size("lines")

    def at(i: Column) -> Column:
        return F.get(F.col("lines"), i)

    def begins(i: Column) -> Column:
        before = at(i - 1)
        return (at(i)["norm"] != "") & ((i == 0) | (before["norm"] == "") | (before["level"] != at(i)["level"]))

    df = df.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), begins))

    def passage(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), n)
        body = F.transform(F.slice("lines", s + 1, end - s), lambda x: x["norm"])
        return F.struct(at(s)["level"].alias("level"), F.array_join(F.filter(body, lambda x: x != ""), " ").alias("norm"), s.alias("first"), (end - 1).alias("last"))

    df = df.withColumn("passages", F.transform("starts", passage))
    single = F.transform(F.filter("lines", lambda x: x["norm"] != ""), lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))
    whole = F.transform("passages", lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))

    def unit(x: Column) -> Column:
        return F.struct(x["level"].alias("level"), F.xxhash64(x["norm"]).alias("h"), F.char_length(x["norm"]).alias("weight"))

    df = df.withColumn("units", F.array_distinct(F.transform(F.concat(whole, single), unit)))

    return df.withColumn("n_quoted", F.size(F.filter("passages", lambda x: x["level"] > 0)).cast("long"))


def _with_own(df: DataFrame) -> DataFrame:
    """Add the own text: all lines but the quoted ones whose passage or line is in ``known`` (hashes)."""
    n = F.size("lines")

    def at(i: Column) -> Column:
        return F.get(F.col("lines"), i)

    def is_known(x: Column) -> Column:
        return F.array_contains(F.col("known"), F.xxhash64(x["norm"]))

    whole = F.filter("passages", lambda x: (x["level"] > 0) & is_known(x))
    df = df.withColumn("known", F.coalesce("known", F.array().cast("array<long>")))
    df = df.withColumn("cut", F.flatten(F.transform(whole, lambda x: F.sequence(x["first"], x["last"]))))

    def goes(i: Column) -> Column:
        return (at(i)["level"] > 0) & (F.array_contains(F.col("cut"), i) | is_known(at(i)))

    def kept(i: Column) -> Column:
        # A line such as "X wrote:" right before a quote that goes introduces it.
        after = F.coalesce(goes(i + 1), F.lit(False))
        introduces = (at(i)["level"] == 0) & at(i)["norm"].rlike("(?:wrote|writes|schrieb|écrit|escribió) ?:$") & after
        # A bare mark stays between quoted lines that stay.
        bare = (at(i)["level"] > 0) & (at(i)["norm"] == "") & (after | (F.coalesce(at(i + 1)["level"], F.lit(0)) == 0))
        return ~goes(i) & ~introduces & ~bare

    own = F.transform(F.filter(F.sequence(F.lit(0), n - 1), kept), lambda i: at(i)["line"])
    return df.withColumn("own", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))


def _links(units: DataFrame) -> DataFrame:
    """For each quoted unit the latest earlier turn of the conversation that said it."""
    quoted = units.where("level > 0").groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.max("weight").alias("weight"))
    said = units.where("level = 0").select("conv_id", "turn", "h").distinct()
    said = said.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    part = F.floor(F.col("turn") / RANGE_TURNS).alias("part")
    both = quoted.select("conv_id", "h", "turn", part, "level", "weight", F.lit(0).alias("own")).unionByName(
        said.select("conv_id", "h", "turn", part, F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight"), F.lit(1).alias("own"))
    )
    said_at = F.when(F.col("own") == 1, F.col("turn"))
    # Quotes stand before the message's own lines: a message does not quote itself.
    back = Window.partitionBy("conv_id", "h", "part").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(said_at).over(back)).where("own = 0")
    ranges = both.groupBy("conv_id", "h", "part").agg(F.max(said_at).alias("last"))
    along = Window.partitionBy("conv_id", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("conv_id", "h", "part", F.max("last").over(along).alias("far"))
    linked = near.join(ranges, ["conv_id", "h", "part"]).withColumn("source", F.coalesce("near", "far")).where("source is not null")
    return linked.select("conv_id", "turn", "level", "weight", "source")


def _threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, thread, depth`` by pointer doubling over the replies."""
    state = checkpointed(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        moved = state.join(up, ["conv_id", "thread"], "left")
        if moved.where("higher is not null").isEmpty():
            return state
        state = checkpointed(
            moved.select("conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )


def reply_ordered(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations without quotes, in reply order, a row per message.

    Returns ``conv_id, thread, turn, depth, reply_to, role, text, n_quoted,
    n_linked``: ``text`` is the message's own text, quotes of
    what no earlier message holds included, ``reply_to`` the turn it
    answers (null if it quotes no earlier message), ``n_quoted`` its quoted
    passages and ``n_linked`` those of its quoted passages and lines that an
    earlier message said.  Sort by ``conv_id, thread, turn`` to read.  Null and
    empty texts stay as messages without text; messages without a conversation
    or turn stand alone; repeated rows stay repeated with one result; an empty
    table gives an empty result.
    """
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    parsed = _parsed(rows)
    # An inner explode would push a filter on the size of ``units`` below the parsing, which then
    # works out the lines anew for every element it looks at; an outer one pushes nothing.
    units = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode_outer("units").alias("u"))
    units = stored(units.where("u is not null").select("conv_id", "turn", "u.level", "u.h", "u.weight"))
    links = checkpointed(_links(units))
    weights = links.groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), F.col("weight"), F.col("source")))
    replies = weights.groupBy("conv_id", "turn").agg(best["source"].alias("reply_to"), F.sum("n").alias("n_linked"))
    replies = checkpointed(replies)
    found = _threads(replies).join(replies.select("conv_id", "turn", "n_linked"), ["conv_id", "turn"])
    # Quoted text goes if an earlier message said it, or quoted it and so holds it where nobody said it.
    seen = units.groupBy("conv_id", "h").agg(F.min("turn").alias("seen"))
    known = units.where("level > 0").join(seen, ["conv_id", "h"]).where("seen < turn").groupBy("conv_id", "turn").agg(F.collect_set("h").alias("known"))
    found = checkpointed(known.join(found, ["conv_id", "turn"], "full"))
    # Messages without a conversation or turn would all meet in one task of the join.
    in_place = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = rows.where(in_place).join(found, ["conv_id", "turn"], "left").unionByName(rows.where(~in_place), allowMissingColumns=True)
    return _with_own(_parsed(placed)).select(
        "conv_id",
        F.coalesce("thread", "turn").alias("thread"),
        "turn",
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        "reply_to",
        "role",
        F.col("own").alias("text"),
        "n_quoted",
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
    )


def conversations(messages: DataFrame, turns: int = 1024, **columns: str) -> DataFrame:
    """Built conversations: per thread an array of its messages in reply order, without quotes.

    Returns ``conv_id, thread, part, messages``, where ``messages`` is
    array<struct<turn, reply_to, depth, role, text>> in the order of turns, so that a
    message follows the one it replies to.  A thread longer than ``turns`` turns comes
    in parts of consecutive turns; so no array grows with its thread.  Messages
    without a conversation or turn are left to :func:`reply_ordered`; a repeated row is
    said once.  An empty table gives an empty result.
    """
    rows = reply_ordered(messages, **columns).where("conv_id is not null and turn is not null")
    rows = rows.withColumn("part", F.floor(F.col("turn") / turns)).select("conv_id", "thread", "part", F.struct("turn", "reply_to", "depth", "role", "text").alias("message"))
    return rows.groupBy("conv_id", "thread", "part").agg(F.sort_array(F.collect_set("message")).alias("messages"))
