"""Bottom-k sketches of word shingles, in DataFrame functions throughout.

A sketch is the sorted array of the k smallest distinct shingle hashes of a text.
Sketches of the parts of a document merge into the sketch of the whole, and two
sketches estimate resemblance, containment and the number of distinct shingles.
Words are runs of characters other than ASCII white space, in lower case; a text
of fewer words than a shingle has is one shingle, a text without words has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed

SIZE, WORDS = 64, 5


def with_sketch(df: DataFrame, text: Column, name: str, k: int = SIZE, n: int = WORDS) -> DataFrame:
    """Add the sketch of ``text`` as column ``name`` (array<long>, empty for null and blank texts).

    The word hashes stand in a column of their own for a moment, so that they are
    computed once; a word is hashed once, a shingle from its words' hashes.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = df.withColumn("__words", words).withColumn("__words", F.transform("__words", lambda w: F.xxhash64(w)))
    h = F.col("__words")
    short = F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<long>"))
    long = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
    shingles = F.when(F.size(h) >= n, long).otherwise(short)
    return hashed.withColumn("__words", shingles).withColumn(name, F.slice(F.sort_array(F.array_distinct("__words")), 1, k)).drop("__words")


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated Jaccard index, 0 to 1; 1 for two texts without shingles."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 if a has none."""
    both = merged(a, b, k)
    own = F.size(F.array_intersect(a, both))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(own == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / own)


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's predecessor by ascending id, the first one's being the last.

    Returns ``id, th, prev_id, prev_th, prev_n``, one row per distinct document:
    ``th`` (a hash of the text) tells documents with one id apart and orders them,
    ``prev_n`` is the predecessor's number of code points.  Ids are ordered in
    ranges; the only table that one task sees has a row per range.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("th"), F.char_length(body).cast("long").alias("n")).distinct()
    ids = ids.repartitionByRange(F.col("id").asc_nulls_first(), "th").sortWithinPartitions(F.col("id").asc_nulls_first(), "th")
    at = F.monotonically_increasing_id()
    ids = checkpointed(ids.select("id", "th", "n", F.shiftright(at, 33).alias("p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    ranges = ids.groupBy("p").agg(F.count(F.lit(1)).alias("rows"))
    ranges = ranges.select("p", (F.sum("rows").over(Window.orderBy("p")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(F.lit(1))).alias("all"))
    ranked = ids.join(F.broadcast(ranges), "p").select("id", "th", "n", (F.col("before") + F.col("i")).alias("rank"), "all")
    before = ranked.select(F.col("id").alias("prev_id"), F.col("th").alias("prev_th"), F.col("n").alias("prev_n"), F.pmod(F.col("rank") + 1, "all").alias("rank"))
    return checkpointed(ranked.join(before, "rank").select("id", "th", "prev_id", "prev_th", "prev_n"))


def fingerprints(docs: DataFrame, k: int = SIZE, n: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint every document and an edited version of it.

    The edit replaces the last half of the code points (rounded down) by the first
    as many of the next document by ascending id, or all of it if it is shorter;
    after the last document comes the first.  Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one
    row per input row.  A null text counts as empty; the fingerprint of a text
    without words is empty.  Null ids come first in the order.  Documents of one
    id follow each other by text; repeated rows are one document and have the
    same result.  A single document follows itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))
    chain = successors(docs, text, doc_id)
    same = rows["id"].eqNullSafe(chain["id"]) & (rows["th"] == chain["th"])
    placed = rows.join(chain, same).select(rows["id"], rows["th"], "text", "prev_id", "prev_th", "prev_n")
    # What a document hands to its predecessor: the text for the edit, and its sketch.
    given = with_sketch(placed, F.col("text"), "next_sketch", k, n).select(
        F.col("prev_id").alias("to_id"), F.col("prev_th").alias("to_th"), F.expr("left(text, int(prev_n div 2))").alias("tail"), "next_sketch"
    )
    # Repeated rows hand over the same; one of them is enough.
    repeats = chain.count() < docs.count()
    given = given.dropDuplicates(["to_id", "to_th"]) if repeats else given
    met = placed["id"].eqNullSafe(given["to_id"]) & (placed["th"] == given["to_th"])
    whole = placed.join(given, met).select("id", "text", "tail", "next_sketch", F.char_length("text").cast("long").alias("n_chars"))
    whole = whole.withColumn("edited", F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), "tail")).drop("tail")
    whole = with_sketch(whole, F.col("text"), "sketch", k, n)
    whole = with_sketch(whole, F.col("edited"), "edited_sketch", k, n)
    return whole.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
