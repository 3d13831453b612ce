"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes each stage's result as Parquet and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, quality, queries, simhash
from tidemark.llm.shared import named
from tidemark.session import ensure_checkpoint_dir

# Near-duplicates of the corpus: five-word shingles; the bits in which the fingerprints of first candidates may differ; and the
# similarity in percent, of the sets themselves, that links two texts. Pairs whose fingerprints lie farther apart are found by rare shingles.
SHINGLE, RADIUS, PERCENT = 5, 4, 80
# A line of so many words is deleted when it repeats, shorter ones only with a line beside them: a passage, not a heading.
LONG_LINE = 50


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of a document with another text, and its length where there is a column for it."""
    new = {"text": named(text), "n_chars": F.length(named(text)).cast("long")}
    return rows.select(*[new.get(c, named(c)).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their source share."""
    return _with_text(quality.judge(docs).filter("q_kept"), docs.columns, "q_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line runs, and the single long lines, that stand earlier in the corpus."""
    return _with_text(line_dedup.dedup_lines(docs, least_lines=2, long_words=LONG_LINE), docs.columns, "l_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=SHINGLE, radius=RADIUS, percent=PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents that are not taken are gone, those taken twice stand there twice."""
    mixed = queries.mixed(docs)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("m_copies").cast("int"))).alias("__copy")
    return mixed.select(*[named(c) for c in docs.columns], copies).drop("__copy")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and their place there."""
    return queries.packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("best_fit_packing", pack_stage),
]

# A subset-sum choice, fingerprints and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; results between stages lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
