"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, mix.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. ``run`` applies them to the documents table, each stage's
result written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality
from touchline.llm.common import numbered, packed, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the rows that op9 learns from."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"), 3, 1))
    scored = quality.score(docs.select("text", packed(docs, "doc")), quality.fit(docs, labels), keep=["doc"])
    return scored.where("predicted = 1").select("doc.*")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones, documents go that lost all they had."""
    cut = line_dedup.cut_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("cut")) > 0))
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("n_removed") > 0, F.length("cut")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    kinds = dict(docs.dtypes)
    return left.select(*((new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    base = numbered(docs.select("doc_id", "text", packed(docs)))
    found = minhash_dedup.near_duplicates(base.select(F.col("row_id").alias("doc_id"), "text"))
    kept = stored(found.where("kept").select(F.col("doc_id").alias("kept_row")))
    return base.join(kept, F.expr("row_id = kept_row"), "left_semi").select("row.*")


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    base = numbered(docs.select("doc_id", "text", packed(docs)))
    found = decontaminate.decontaminate(base.select(F.col("row_id").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("bad_row")))
    return base.join(bad, F.expr("row_id = bad_row"), "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_filter),
    ("minhash_dedup", near_dedup),
    ("decontamination", benchmark_filter),
    ("mixing", source_mix),
]
#: SQL expresses neither the classifier nor the dual's solution; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
