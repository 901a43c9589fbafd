"""The nearest players of every waiting player at once: a band join that looks only where its k best can be.

Within a queue, players of one rating are one group, of which the first k by id are
all that anyone can need.  Groups are numbered by rating; the k nearest players lie within k groups
below and k above.  Groups are held in blocks that overlap by k, so each
anchor meets one row: its block.  No pair is made of an anchor and a player who is
not among its 2k groups, however wide its band or however full its queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import rating_or_default
from tidewell.operators.matchmaking import QUEUE
from tidewell.operators.ranking import running_total

#: Groups in a block at least, besides the overlap.
BLOCK = 64


def _by_rating(players: DataFrame, k: int) -> DataFrame:
    """``game_id, region, rating, ids``: the first k ids of every rating; a hot rating is cut in each task before it is shuffled."""
    first = Window.partitionBy(*QUEUE, "rating").orderBy("player_id")
    rated = players.select(*QUEUE, rating_or_default(F.col("rating")).alias("rating"), "player_id").where("player_id IS NOT NULL")
    few = rated.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    return few.groupBy(*QUEUE, "rating").agg(F.sort_array(F.collect_list("player_id")).alias("ids"))


def nearest_to_all(players: DataFrame, anchors: DataFrame, k: int, width: Column) -> DataFrame:
    """For every anchor its queue's k players nearest by rating, within the anchor's own width, bounds inclusive.

    ``anchors`` has ``game_id, region, player_id, rating`` and what ``width`` needs; they may
    be players or not, and a player is among their own nearest.  Returns ``game_id, region, anchor_id,
    anchor_rating, place, player_id, rating, distance``; ties go to the lower rating, then
    the smaller id.  A missing rating counts as the default.  Anchors with nobody in reach
    give no rows; null widths reach nobody.  Repeated anchors have rows of their own;
    repeated players are as many candidates.  Anchors that agree in queue, rating and width share one search.
    """
    if k < 1:
        raise ValueError("at least one neighbour is wanted")
    size = max(BLOCK, 2 * k)
    wanted = anchors.select(*[F.col(q).alias(f"of_{q}") for q in QUEUE], F.col("player_id").alias("anchor_id"), rating_or_default(F.col("rating")).alias("anchor_rating"), width.alias("reach"))
    of = [f"of_{q}" for q in QUEUE]
    searches = wanted.select(*of, "anchor_rating", "reach").where("reach IS NOT NULL").distinct()
    groups = _by_rating(players, k)
    # Numbers of groups, and for every rating that is asked for the number of groups up to it.
    asked = searches.select(*[F.col(f"of_{q}").alias(q) for q in QUEUE], F.col("anchor_rating").alias("rating"), F.lit(None).cast(groups.schema["ids"].dataType).alias("ids")).distinct()
    numbered = running_total(groups.unionByName(asked), QUEUE, ["rating", F.col("ids").isNull()], F.when(F.col("ids").isNull(), 0).otherwise(1), "number")
    held = numbered.where("ids IS NOT NULL")
    block = lambda n: F.floor(n / size).cast("long")
    blocks = (
        held.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("number") - k), block(F.col("number")), block(F.col("number") + k)))))
        .groupBy(*QUEUE, "block")
        .agg(F.collect_list(F.struct("number", "rating", "ids")).alias("groups"))
    )
    places = numbered.where("ids IS NULL").select(*[F.col(q).alias(f"at_{q}") for q in QUEUE], F.col("rating").alias("at_rating"), "number")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    located = searches.join(places, same("of_game_id", "at_game_id") & same("of_region", "at_region") & (F.col("anchor_rating") == F.col("at_rating")))
    located = located.select(*of, "anchor_rating", "reach", "number", block(F.col("number")).alias("at_block")).withColumnRenamed("number", "at_number")
    met = located.join(blocks, same("of_game_id", "game_id") & same("of_region", "region") & (F.col("at_block") == F.col("block")))
    off = lambda g: F.abs(g["rating"] - F.col("anchor_rating"))
    near = F.filter("groups", lambda g: (g["number"] > F.col("at_number") - k) & (g["number"] <= F.col("at_number") + k) & (off(g) <= F.col("reach")))
    best = F.flatten(F.transform(near, lambda g: F.transform(g["ids"], lambda p: F.struct(off(g).alias("distance"), g["rating"].alias("rating"), p.alias("player_id")))))
    found = met.select(*[F.col(c).alias(f"to_{c}") for c in (*of, "anchor_rating", "reach")], F.slice(F.sort_array(best), 1, k).alias("best"))
    match = same("of_game_id", "to_of_game_id") & same("of_region", "to_of_region") & (F.col("anchor_rating") == F.col("to_anchor_rating")) & (F.col("reach") == F.col("to_reach"))
    rows = wanted.join(found, match).select(*of, "anchor_id", "anchor_rating", F.posexplode("best").alias("at", "p"))
    return rows.select(*[F.col(f"of_{q}").alias(q) for q in QUEUE], "anchor_id", "anchor_rating", (F.col("at") + 1).alias("place"), "p.player_id", "p.rating", "p.distance")
