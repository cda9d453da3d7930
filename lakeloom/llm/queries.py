"""The registered queries of the text operators, and SQL where it can express them.

Each reads its whole table, applies its operator with production parameters and returns one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, jaccard, langid, packing, pii, quality, separators, sequences, suffixes, wordbpe
from .common import crc_text

#: The id that ends a document in op6, and the vocabulary's own end of text, which separates documents in op5.
END_ID = 1
END_OF_TEXT = 49407

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def word_vocabulary() -> str:
    """The place of the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from three quarters of the documents, predicted for all of them. A row without an id is not held out."""
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(crc_text("doc_id") % 4 == 2, F.lit(False))
    prototypes = langid.train(docs.where(~held_out))
    return langid.identify(docs, prototypes, keep=[held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir), keep="max")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = wordbpe.encode_documents(_documents(spark, sf_dir), word_vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary=word_vocabulary())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat files of all documents, counted by a scan for the separator."""
    files, listing = separators.write_flat(_documents(spark, sf_dir), word_vocabulary(), END_OF_TEXT)
    counted = separators.count_tokens(spark, files, END_OF_TEXT)
    return listing.join(counted, ["path", "ordinal"], "full").select("doc_id", "ordinal", "start", "n_tokens", "ended")


def op6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sequences.write_sequences(_documents(spark, sf_dir), word_vocabulary(), END_ID)
    return sequences.read_documents(spark, files)


QUERIES["op1_language_id"] = op1_language_id
QUERIES["op2_exact_dedup"] = op2_exact_dedup
QUERIES["op3_bpe"] = op3_bpe
QUERIES["op4_packing"] = op4_packing
QUERIES["op5_token_counts"] = op5_token_counts
QUERIES["op6_sequences"] = op6_sequences
ORACLE_SQL["op2_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(_documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op9_repeated_strings"] = op9_repeated_strings
ORACLE_SQL["op9_repeated_strings"] = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, n, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)
), f AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id
), r AS (
    SELECT doc_id, p, sum(CASE WHEN p - prev <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM f)
), s AS (
    SELECT doc_id, run, min(p) AS lo, max(p) + 50 AS hi FROM r GROUP BY doc_id, run
), k AS (
    SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM s
    UNION ALL
    SELECT s.doc_id, max(s.hi), any_value(d.n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id
), t AS (
    SELECT k.doc_id, string_agg(substr(d.h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
), c AS (
    SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir), words=3, num=90, den=100)


QUERIES["op8_ngram_jaccard"] = op8_ngram_jaccard
ORACLE_SQL["op8_ngram_jaccard"] = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 2], ' ') END AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id AS origin, doc_id AS hop FROM documents
    UNION
    SELECT r.origin, e.y FROM r JOIN e ON e.x = r.hop
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(hop) FROM r WHERE r.origin = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.quality(docs, quality.learn_references(docs))


QUERIES["op10_quality_rules"] = op10_quality_rules


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.detect(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: ~s["loose"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.withColumn("base", base).select("doc_id", *[of(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


QUERIES["op7_personal_data"] = op7_personal_data
