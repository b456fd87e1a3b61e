"""The registered queries of the corpus operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm import alignment, decontamination, hard_negatives, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, secrets, suffix_dedup, tensor_minhash, toxicity, url_filter
from scrivia.llm.common import crc_mod, table
from scrivia.sources.tables import spread


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out over the cores where they come in fewer parts, as from one small file; larger tables are read as they lie."""
    return spread(table(spark, sf_dir, "documents"))


def _predicted(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return _predicted(toxicity.score(docs, toxicity.fit(docs, labels)), 4, 2)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return _predicted(quality_classifier.score(docs, quality_classifier.fit(docs, labels)), 5, 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rule")


#: Host suffix, path prefix, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE)))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def packed_digest(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenise(docs, tokenizer_file())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(decontamination.items_hit())
    return found.select(
        "doc_id", "n_words", decontamination.covered_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tensor_minhash.near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 50 = 0")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_quality_rules, op4_url_filter, op5_secret_scan, op6_best_fit_packing, op7_lm_scoring, op8_suffix_dedup, op9_quality_classifier, op10_decontamination, op11_minhash_near_dedup, op12_tokenizer_alignment, op13_hard_negatives)}
