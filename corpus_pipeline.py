"""A corpus run end to end: quality, near duplicates, decontamination, secrets, mixing.

Every stage takes what its predecessor kept and returns the columns of
``documents``; the last returns the mix, with ``copy`` counting a document's
repetitions.  Between stages the documents are written as Parquet in the shared
folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import decontamination, mixing, near_duplicates, quality, secrets
from lodegraph.llm.common import materialise, table
from lodegraph.llm.queries import quality_model


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.where(F.col("score") >= 0.5).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8), that of the smallest id.

    Rows are judged each on its own: repeated rows, rows without id and several
    texts under one id take part like all others.  Texts without words have no
    shingles; only repeats of the same id and text go.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component")
    )
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = numbered.select("_row", "doc_id", F.when(blank, F.col("text")).alias("blank"))
    wordless = F.col("component").isNull()
    placed = materialise(
        rows.join(judged, "_row").select(
            "_row", "doc_id", "component", F.when(wordless, F.col("doc_id")).alias("same_id"), "blank"
        ),
        "placed",
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = placed.groupBy("component", "same_id", "blank").agg(F.min(order)["_row"].alias("_row"))
    gone = materialise(placed.select("_row").join(first.select("_row"), "_row", "left_anti"), "duplicates")
    return numbered.join(gone, "_row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    found = secrets.scan(docs, redact=True)
    dirty = F.size("secrets") > 0
    return found.withColumn(
        "n_chars", F.when(dirty, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact),
    ("source mixing", mix),
]

#: The classifier's training and the components of near duplicates are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
