"""From raw documents to token ids: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages that filter keep what they
have nothing against; null texts go at the first stage, as they have no
language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymere.llm import decontaminate, language, line_dedup, ngram_join, pieces
from tallymere.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if no language holds this share of its letters.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, without letters, or of no prevailing language."""
    model = language.learn(docs.where(~language.held_out()))
    found = language.identify(docs.select(*COLUMNS), model)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    if not model.languages:
        sure = F.col("row.text").rlike(r"\p{L}")
    return found.where(sure).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines; a document of which no word is left goes."""
    out = line_dedup.remove_repeated_passages(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", "text", "row.lang", "row.source", changed.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text: doc_id, lang, source, n_pieces, ids, round_trip."""
    vocabulary = pieces.Pieces.load()
    out = pieces.encode(docs.select(*COLUMNS), vocabulary, decoded=True)
    same = F.col("decoded").eqNullSafe(F.replace("row.text", F.lit(pieces.SPACE), F.lit(" ")))
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The learnt language model and the vocabulary's best paths are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
