"""A corpus pipeline over the documents table: language, exact and near duplicates, benchmark passages, packing.

Each stage takes all that the one before it kept, and its result is written to the shared folder as Parquet and read again
as the next one's documents, so a failed stage is repeated alone. All stages but the last return the columns of documents,
and any other columns untouched.

Defined results: documents without a letter (null and empty ones among them) leave at the first stage; of rows with equal
texts one row stays, also where they share a doc_id or have none; rows that repeat a doc_id with different texts are one
document for the near-duplicate stage, and stay or go together; rows without doc_id link with nothing there and stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelore.llm.common import lower_az, stage, table
from gatelore.llm.decontaminate import remove_contaminated
from gatelore.llm.exact_dedup import exact_duplicates
from gatelore.llm.language import keep_known, learn
from gatelore.llm.near_dedup import near_duplicates
from gatelore.llm.packing import best_fit_pack

#: A prediction below so many times the chance of a guess among the learned languages is none.
ABOVE_CHANCE = 1.2
#: Rows of whole texts that cross to Python at once, where the session sets no number of its own.
ROWS_AT_ONCE = 1000


def _in_small_batches(spark: SparkSession) -> None:
    """Spark's 10,000 rows of two whole texts each are held outside the heap, in full, by the executor and by its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: not ``und``, and predicted better than by a guess."""
    _in_small_batches(spark)
    return keep_known(docs, learn(docs), ABOVE_CHANCE)


def _with_ids_in(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``kept``, and all rows without doc_id, which take no part in the join."""
    ids = stage(kept.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct(), "kept-ids")
    return docs.join(ids, F.col("doc_id") == F.col("_kept_id"), "left_semi").union(docs.filter("doc_id IS NULL"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: one with its largest doc_id."""
    _in_small_batches(spark)
    kept = exact_duplicates(docs, keep="largest").filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    kept = stage(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"), "times"), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.sha2(lower_az(F.col("text")), 256).alias("digest"))
    found = rows.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")))
    if kept.filter("times > 1").isEmpty():
        return found.select("row.*")
    # only rows that repeat both id and text are dealt out once more
    once = found.filter("times = 1").select("row").union(found.filter("times > 1").dropDuplicates(["id", "digest"]).select("row"))
    return once.select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates, and documents without doc_id, which link with nothing."""
    _in_small_batches(spark)
    return _with_ids_in(docs, near_duplicates(docs).filter("kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item."""
    _in_small_batches(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    _in_small_batches(spark)
    return best_fit_pack(docs, capacity=2048)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: Tokenisation and set similarity are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
