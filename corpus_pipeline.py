"""Clean a corpus in stages, each of which works on all that the one before it has kept and written.

Documents of low quality go, then lines that many documents share, then near copies; sources are
mixed to their target weights, and what is left is encoded. Every stage but the last returns the
columns of ``documents``, and further columns if there are any, whatever their names. Every stage takes
nulls in any column, texts of any length, repeated rows and empty tables: no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import line_runs, pieces, poisson_mix, rff_quality, simhash_ring
from shelfmark.llm.common import table
from shelfmark.llm.queries import DISTANCE, MIN_DOCS, MIX_SEED, MIX_WEIGHTS, SHINGLE_WORDS, tokenizer_model
from shelfmark.session import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go. Null texts are scored as empty ones, rows without doc_id like all
    others; repeated rows share their score, and a score of just one half stays. Without labels of both classes
    all documents have one score."""
    return rff_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; n_chars follows the text. A null text stays null, a document all of whose
    lines go stays with an empty text; each row counts as a document, repeated rows and rows without doc_id too."""
    kept = line_runs.drop_frequent_lines(docs, MIN_DOCS)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars.cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (three-word SimHashes that links of at most three bits connect) the
    document with the least doc_id stays, once if its row is repeated. Null and empty texts are near copies of
    each other; of a group without any doc_id each different text stays."""
    return simhash_ring.keep_one(docs, simhash_ring.near_groups(docs, SHINGLE_WORDS, DISTANCE))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target shares, and shuffled. A null source
    is a source of its own, a null text weighs one byte; rows that repeat a doc_id share its draw, rows without
    one are drawn by their text."""
    return poisson_mix.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends, text): ids, the bytes each of them spans, and the text they decode to.
    A null text is encoded as an empty one; each row gives one row; long texts are encoded whole."""
    encoded = pieces.encode(docs, tokenizer_model(), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", "begins", "ends", F.col("decoded").alias("text")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]
# Learnt scores, fingerprints and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
