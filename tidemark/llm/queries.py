"""The thin ``opN_*`` queries: each applies its operator, with production parameters,
to its whole table and derives the contract's columns from what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, jaccard_join, language_id, lm_score, mixing, rules, sharding, token_counts, vector_codes, vector_graph, warc_zip, whitening


PIECE_MODEL, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to ZIP-packaged WARC archives and read back by range."""
    return warc_zip.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the sentencepiece model."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), limit=4096)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text by the attention model and by word counts."""
    return lm_score.score(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word shingles overlap by at least 0.8."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"), percent=80, width=5)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of at least 0.98 under one label."""
    return vector_graph.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)[0]


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents outside the held-out fold."""
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), depth=4)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals, distances from the language's references, and the verdict."""
    return rules.judge(_table(spark, sf_dir, "documents")).drop("lang")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components, whitened."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), k=16)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as sixteen entries of 64-entry codebooks, with its error."""
    return vector_codes.with_label_error(vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    return contamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_lm_score": op4_lm_score,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_shard": op6_shard,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_contamination": op13_contamination,
}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: What SQL can express, for DuckDB; the other queries are random, learned or a library's, and are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""",
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) c ON c.a = e.vec_id""",
    "op12_vector_codes": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT vec_id, label, p.part, x[p.part * (len(x) // 16) + 1 : (p.part + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS part) p),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM q QUALIFY entry < 64),
a1 AS (SELECT vec_id, q.part, any_value(x) AS x, min((list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), entry)) AS best FROM q JOIN c0 ON q.part = c0.part GROUP BY vec_id, q.part),
m1 AS (SELECT part, best[2] AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a1, (SELECT unnest(range(1, 5)) AS i) GROUP BY part, best[2], i),
c1 AS (SELECT c0.part, c0.entry, coalesce(any_value(n.c), any_value(c0.c)) AS c FROM c0 LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS c FROM m1 GROUP BY part, entry) n ON n.part = c0.part AND n.entry = c0.entry GROUP BY c0.part, c0.entry),
a2 AS (SELECT vec_id, q.part, any_value(x) AS x, min((list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), entry)) AS best FROM q JOIN c1 ON q.part = c1.part GROUP BY vec_id, q.part),
m2 AS (SELECT part, best[2] AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a2, (SELECT unnest(range(1, 5)) AS i) GROUP BY part, best[2], i),
c2 AS (SELECT c1.part, c1.entry, coalesce(any_value(n.c), any_value(c1.c)) AS c FROM c1 LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS c FROM m2 GROUP BY part, entry) n ON n.part = c1.part AND n.entry = c1.entry GROUP BY c1.part, c1.entry),
a3 AS (SELECT vec_id, any_value(label) AS label, q.part, min((list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), entry)) AS best FROM q JOIN c2 ON q.part = c2.part GROUP BY vec_id, q.part),
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, k""",
    "op13_contamination": """WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS window, least(len(w), 10) AS m FROM w WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
x AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
o AS (SELECT DISTINCT x.doc_id, x.i, x.m, p.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS window FROM x) x JOIN p ON x.m = p.m AND x.window = p.window),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
