"""Corpus pipeline: quality rules, language identification, near-duplicate removal, source
mixing and BPE round trip over ``documents``, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, language_id, mixing, rules
from tidemark.llm.queries import WORD_BPE, tokenizer_path
from tidemark.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected as foreign only if its own language's label is known and another language is this sure.
MIN_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each as often as it is there.

    A null or short text goes, whatever its other columns hold; a null doc_id, lang or source is no reason to go.
    """
    return rules.judge(docs, keep=("text", "source", "n_chars")).where("kept").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: ``und`` goes, and so does what is surely not in the language it claims.

    A row without lang claims none and stays; repeated rows and rows without doc_id are judged like any other.
    """
    found = language_id.identify(docs, keep=tuple(COLUMNS))
    other = F.coalesce(F.col("lang") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= MIN_SCORE)
    return found.where((F.col("lang_pred") != "und") & ~other).select(COLUMNS)


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_hash) in ``chosen``, which tells how many ``rows`` are alike in that."""
    known = chosen.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), *[c for c in chosen.columns if c not in ("doc_id", "text_hash")])
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    if chosen.where("rows > 1").isEmpty():
        return joined
    # only rows that are there several times meet
    return joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["doc_id", "text_hash"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the least doc_id, null being the last, and
    of rows that share it the one whose text has the least hash.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, stay unless their
    texts are near duplicates; of rows alike in both one stays.  Texts without a word link with nothing:
    of those one stays for each doc_id.
    """
    found = jaccard_join.classes(docs)
    alike = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows")
    linked = alike.where("component is not null").groupBy("component").agg(F.min(place).alias("best")).select("best.doc_id", "best.text_hash", "best.rows")
    kept = written(linked.union(alike.where("component is null").select("doc_id", "text_hash", "rows")), "pipeline-kept")
    return _rows(docs, kept).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows alike in doc_id, text and source share their copies.

    A row of which the mix takes nothing, such as one without words, goes.
    """
    mixed = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    joined = _rows(docs, written(mixed, "pipeline-mixed"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row, and digests of its ids and of what they decode to; a null text counts as empty."""
    return bpe.encode_texts(docs, tokenizer_path(WORD_BPE), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: SQL can't express the tokenizer, nor the mix's random transfers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
