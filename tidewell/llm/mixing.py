"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight.  A source cannot give more than a
maximum number of epochs of its own size: it is clamped there, and what it leaves
goes to the others by weight, until no target is above its cap.  The fixed point
of that loop has a closed form (sort by cap over weight, compare running sums),
which is what :func:`water_fill` computes.

Documents are then repeated whole as often as the target allows; the rest is
taken from a seeded random order of each source: documents before the cut once
more, and the one at the cut with its first words only, so each source's words
meet its target to the word.  The cut is found by descending through prefixes
of the order key with pre-aggregated sums, so a source that holds most rows is
never sorted or gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed, free_name, stored, word_count

#: With more sources than this the plan is joined by a shuffle instead of being broadcast.
BROADCAST_SOURCES = 10_000
#: Hex digits of the order key that each level of the descent adds, and the levels: a source's window sees 256 cells at most.
DIGITS, LEVELS = 2, 4


def order_key(seed: int, doc_id: Column, text: Column) -> Column:
    """The seeded place of a document within its source, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text).cast("binary"))


def water_fill(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size).

    Weights repeat along the sources in code point order, null last.  The input
    has a row per source; its windows see only these rows.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(everywhere) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("double") for w in weights]), (n % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(epochs)).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    steps = caps.select(
        "*",
        (F.sum("source_size").over(all_rows) * share).alias("budget"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("clamped"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
    )
    level = (F.col("budget") - F.col("clamped")) / F.col("open_w")
    # The first source, by ratio, that stays below its cap sets the level; it is the smallest such level.
    first = F.min(F.when(level <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), level.alias("level")))).over(all_rows)
    return steps.select("source", "source_size", "w", "cap", first["level"].alias("level")).select(
        "source",
        "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"),
    )


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int, source: str = "source") -> DataFrame:
    plan = plan.withColumnRenamed("source", "plan_source")
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    return rows.join(plan, rows[source].eqNullSafe(plan["plan_source"])).drop("plan_source")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 17,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> tuple[DataFrame, DataFrame, int]:
    """The documents' sizes and keys, the plan of each source, and the number of sources.

    Plan: ``source, source_size, target, whole`` (full repetitions of every
    document), ``cut_key`` (documents with a smaller key count once more) and
    ``cut_words`` (what the documents at the key give once more).
    """
    sized = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
            order_key(seed, F.col(doc_id), F.col(text)).alias("key"),
        )
    )
    targets = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.least(F.expr("floor(target + 0.5) div source_size"), F.lit(epochs))).otherwise(0).cast("long")
    plan = checkpointed(
        targets.select("source", "source_size", "target", whole.alias("whole"), (words - whole * F.col("source_size")).alias("rest"))
    )
    n_sources = plan.count()
    state = plan.where("rest > 0").select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        inside = _with_plan(sized, state, n_sources).where(F.expr("startswith(key, prefix)"))
        cells = inside.groupBy("source", "rest", "before", F.substring("key", 1, DIGITS * level).alias("cell")).agg(F.sum("size").alias("n"))
        along = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.col("before") + F.sum("n").over(along))
        state = checkpointed(
            cells.where("upto >= rest and upto - n < rest").select("source", "rest", F.col("cell").alias("prefix"), (F.col("upto") - F.col("n")).alias("before"))
        )
    inside = _with_plan(sized, state, n_sources).where(F.expr("startswith(key, prefix)"))
    keys = inside.groupBy("source", "rest", "before", "key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    keys = keys.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key")))
    cuts = keys.where("upto >= rest and upto - n < rest").select(
        F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.expr("(rest - (upto - n)) div rows").alias("cut_words")
    )
    full = plan.join(cuts, plan["source"].eqNullSafe(cuts["cut_source"]), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).cast("long").alias("cut_words")
    )
    return sized, checkpointed(full), n_sources


def mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document.

    Returns ``doc_id, size, source_size, target, taken``, one row per input row.
    Null or empty texts have size 0 and give nothing; a null source is a source
    of its own; rows that are alike in id and text share a place in the order and
    give equal parts; an empty table gives an empty result.
    """
    sized, plan, n = mix_plan(docs, **options)
    return _with_plan(sized, plan, n).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's rows and columns, repeated as planned.

    The document at a source's cut comes once more with its first words only,
    joined by single spaces.
    """
    text, doc_id, source = (options.get(k, k) for k in ("text", "doc_id", "source"))
    _, plan, n = mix_plan(docs, **options)
    plan = plan.select("source", "whole", "cut_key", "cut_words")
    names = {c: free_name(docs, f"mix_{c}") for c in ("key", "whole", "cut_key", "cut_words", "copy", "source")}
    plan = plan.select(*[F.col(c).alias(names.get(c, c)) for c in ("source", "whole", "cut_key", "cut_words")])
    plan = F.broadcast(plan) if n <= BROADCAST_SOURCES else plan
    keyed = docs.withColumn(names["key"], order_key(options.get("seed", 17), F.col(doc_id), F.col(text)))
    rows = keyed.join(plan, F.col(source).cast("string").eqNullSafe(plan[names["source"]]))
    extra = (F.col(names["key"]) < F.col(names["cut_key"])) | ((F.col(names["key"]) == F.col(names["cut_key"])) & (F.col(names["cut_words"]) > 0))
    copies = F.col(names["whole"]) + F.when(extra, 1).otherwise(0)
    rows = rows.withColumn(names["copy"], F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
    part = (F.col(names["copy"]) > F.col(names["whole"])) & (F.col(names["key"]) == F.col(names["cut_key"]))
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), F.col(names["cut_words"]).cast("int")))
    return rows.withColumn(text, F.when(part, head).otherwise(F.col(text))).select(*docs.columns)
