"""The corpus operators bound to the standard tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import table
from tidewell.llm.rules import STOP_WORDS

VOCAB = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty, with no tokens; repeated rows and null ids are rows of their own; no documents, no rows."""
    from tidewell.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are their end id alone; repeated rows are packed as often as they occur; null ids are kept; no documents, no pieces."""
    from tidewell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '17', doc_id::VARCHAR, text)) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM sources),
steps AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM caps),
filled AS (SELECT *, (budget - clamped) / open_w AS level FROM steps),
targets AS (
  SELECT source, source_size,
         least(cap, (SELECT arg_min(level, ratio) FROM filled WHERE level <= ratio) * w) AS target
  FROM filled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target + 0.5)::BIGINT // source_size, 2) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""


@query("op10_source_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts have size 0 and are taken 0 times; a null source is a source of its own; rows alike in id and text share a place and give equal parts; no documents, no rows."""
    from tidewell.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
   AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, d.n AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM sized d
"""


@query("op8_ngram_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts have no shingles and link with nothing; equal sets are one node; documents of one id are told apart by their sets; documents without an id take part, and a component of such alone is null; no documents, no rows."""
    from tidewell.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts score as texts without words; repeated rows score alike; a null id is not held out; no documents, no rows."""
    from tidewell.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts score as texts without words; repeated rows score alike; a null id is not held out; no documents, no rows."""
    from tidewell.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_exact_top_k", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null or hold what is no number take no part; ties go to the smaller id; no vectors, no rows."""
    from pyspark.sql import functions as F

    from tidewell.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; null ids come first in the order; repeated rows have one result each; no documents, no rows."""
    from tidewell.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages give empty texts; a null url is a host of its own; repeated rows stay; no pages, no rows."""
    from tidewell.llm.htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query("op3_chat_formatting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are messages without text; messages without a conversation or turn stand alone; repeated rows stay; no messages, no rows."""
    from tidewell.llm.chat import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


#: The thresholds stand here a second time, as numbers.
OP11_SQL = r"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x
  FROM body),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts))),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
counts AS (
  SELECT p.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda v: length(v)))::BIGINT AS chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(x)::BIGINT AS n_lines, len(regexp_extract_all(t, '!')) AS bangs,
         len(list_filter(w, lambda v: lower(v) <> upper(v))) AS lettered,
         len(list_filter(w, lambda v: upper(v) = v AND lower(v) <> v AND length(v) > 1)) AS uppers,
         len(list_filter(w, lambda v: list_contains([{stop_words}], lower(v)))) AS stops,
         len(list_filter(x, lambda v: regexp_matches(v, '^ *[-*•‣·]'))) AS bullets,
         len(list_filter(x, lambda v: regexp_matches(v, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= n_words AND 10 * bangs <= 3 * n_words AND 10 * lettered >= 7 * n_words
         AND 2 * uppers <= n_words AND stops >= 2 AND 50 * stops >= n_words
         AND 10 * bullets <= 9 * n_lines AND 10 * ellipses <= 3 * n_lines AND 2 * n_dup_lines <= n_lines AS kept
FROM counts
"""


@query("op11_quality_rules", OP11_SQL.replace("{stop_words}", ", ".join(f"'{w}'" for w in STOP_WORDS)))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts count 0 of everything and fail the base rules; null ids and repeated rows are rows of their own; no documents, no rows."""
    from tidewell.llm.rules import judged

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)


OP12_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM drawn),
formed AS (
  SELECT *, least(a, b) AS one, greatest(a, b) AS two,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, left(t, one) AS p, substr(t, one + 1, two - one) AS m, substr(t, two + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN one::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (two - one)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are plain; repeated rows are cut alike, and so are texts of one length without an id; no documents, no rows."""
    from pyspark.sql import functions as F

    from tidewell.llm.infill import infilled, restored

    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    made = infilled(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        hashed(F.col("output")).alias("output_sha256"),
        hashed(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


@query("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no features and weigh 0; ties go to the smaller id, null ids first; repeated rows rank one after another; no documents, no rows."""
    from tidewell.llm.importance import resampled

    made = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")
