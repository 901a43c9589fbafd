"""Labelled rows for the classifiers: a bounded, seeded sample that never sees held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc_id: str = "doc_id") -> list[tuple[str, int]]:
    """At most ``rows`` pairs (text, label) of documents that are not held out.

    The ids are drawn by a hash of the id, from labels alone, so the draw costs
    one pass over the label table and the same ids come out each time.  ``rows``
    bounds what reaches the driver.  Labels other than 0 and 1, null ids and null
    texts take no part; of several labels of one id the larger counts.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).cast("long").alias("label_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("label_id"), F.col(text).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(ids), "label_id").groupBy("label_id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in found.orderBy("label_id").select("text", "y").toLocalIterator()]
