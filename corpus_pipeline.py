"""The training-corpus pipeline: stages over `documents`, each written and read again before the next.

No SQL expresses the learned and the packed stages; tests compare a run with the stages' brute-force versions.

Every stage takes empty tables (no rows come out), null ids and texts, very long texts (whole) and other columns of any name, which all but the last pass on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.lineage import shared_folder
from scrivia.llm import decontamination, ngram_join, quality_classifier, secrets
from scrivia.llm.common import table
from scrivia.llm.queries import packed_digest


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all labels.

    Texts without words score alike and go or stay together, as do repeated rows; a score of just 0.3 stays.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    name = "_quality" + "_" * max(map(len, docs.columns))  # no column of docs has it
    return quality_classifier.score(docs, model, carry=rest, score_col=name).filter(F.col(name) >= 0.3).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the least id, then the least hash of its text; of rows repeated with id and text any.

    Rows without an id come last. Texts without words are classes of their own, so all their rows stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    name = "_key" + "_" * max(map(len, docs.columns))  # no column of docs has it
    keyed = docs.withColumn(name, key)
    found = ngram_join.similar_documents(keyed, id_col=name)
    chosen = found.filter(F.col(name) == F.col("class_id")).groupBy(F.col(name).alias("_chosen")).agg(F.count("*").alias("_rows"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = keyed.join(chosen.filter("_rows = 1"), F.col(name) == F.col("_chosen"), "left_semi")
    repeated = keyed.join(chosen.filter("_rows > 1"), F.col(name) == F.col("_chosen"), "left_semi")
    return once.unionByName(repeated.filter(~worded)).unionByName(repeated.filter(worded).dropDuplicates([name])).select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, ids or none; texts without words stay, and repeated rows go or stay together."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every maximal run of secrets replaced by a mark and n_chars counted anew; null texts stay null, repeated rows stay repeated. A column named spans is left out."""
    found = secrets.find_secrets(docs, keep_text=True)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select([c for c in docs.columns if c != "spans"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences; null texts are empty, and repeated rows are packed each for itself."""
    return packed_digest(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scan", redacted),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages between are written to the folder in spark.checkpoint.dir."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{k}")
            docs = spark.read.parquet(f"{shared}/{k}")
    return docs
