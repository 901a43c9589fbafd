"""Counts, packing and mixing on empty tables, repeated rows and texts without words."""

import public_tokenizers
from pyspark.sql import functions as F

from tidewell.llm import mixing, packing, tokens

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "two words", "a")] * 3 + [(None, "two words", None)] * 2 + [(2, None, "a"), (2, None, "a")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("shard", "size", "key", "n_tokens", "start", "target")})
    counts = tokens.token_counts(frame, VOCAB).collect()
    assert len(counts) == 7 and len({r.n_tokens for r in counts if r.doc_id != 2}) == 1
    pieces = packing.pack(frame, VOCAB).collect()
    assert len(pieces) == 7 and len({(p.sequence_id, p.offset) for p in pieces}) == 7
    mixed = mixing.mix(frame).collect()
    assert len(mixed) == 7 and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    assert mixing.mixed_documents(frame).columns == frame.columns
    for made in (tokens.token_counts(frame.limit(0), VOCAB), packing.pack(frame.limit(0), VOCAB), mixing.mix(frame.limit(0)), mixing.mixed_documents(frame.limit(0))):
        assert made.count() == 0


def test_a_mix_without_words(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, " \n", "b"), (3, "", None)], SCHEMA)
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(frame).collect()] == [(0, 0, 0.0, 0)] * 3
    assert mixing.mixed_documents(frame).count() == 0


def test_windows_are_as_many_as_a_plain_best_fit_opens(spark):
    """One shard against a scan over all open windows; pieces a window long stay whole."""
    window = 64
    frame = spark.createDataFrame([(k, "word " * (5 * k % 200), "a") for k in range(400)], SCHEMA)
    pieces = packing.pack(frame, VOCAB, window=window).collect()
    rooms: list[int] = []
    for n in sorted((p.length for p in pieces), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(window - n)
    used: dict[int, int] = {}
    for p in pieces:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    assert sorted(window - n for n in used.values()) == sorted(rooms)
    full = [p for p in pieces if p.length == window]
    assert full and len({p.sequence_id for p in full}) == len(full)
