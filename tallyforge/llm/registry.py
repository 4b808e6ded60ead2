"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from pyspark.sql import functions as F

from tallyforge.llm import alignment, gif_media, jaccard_join, kd_sharding, language_id, line_dedup, packing, periodic_runs, quality_rules, repeated_bytes, secret_scans, sentencepiece_bpe, url_filters
from tallyforge.llm.common import documents
from tallyforge.llm.oracles import ORACLE_SQL  # noqa: F401


#: The fixed rules of op1.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filters.judge(url_filters.labelled_pages(pages, labels), RULES)


def op2_kd_sharding(spark, sf_dir):
    out = kd_sharding.shard(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op4_gif_media(spark, sf_dir):
    return gif_media.digests(gif_media.texts_as_gifs(documents(spark, sf_dir, "doc_id", "text")))


def op5_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op6_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "text").withColumnRenamed("source", "host")
    out = quality_rules.quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.digests(documents(spark, sf_dir, "doc_id", "text"))


def op8_secret_scans(spark, sf_dir):
    return secret_scans.secret_scans(documents(spark, sf_dir, "doc_id", "text")).drop("found")


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.linked(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op10_suffix_array_dedup(spark, sf_dir):
    return repeated_bytes.repeated_bytes(documents(spark, sf_dir, "doc_id", "text"))


def op11_line_dedup(spark, sf_dir):
    return line_dedup.digests(documents(spark, sf_dir, "doc_id", "text"))


def op12_alignment(spark, sf_dir):
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_kd_sharding, op3_best_fit_packing, op4_gif_media, op5_language_id, op6_quality_rules, op7_sentencepiece, op8_secret_scans, op9_jaccard_join, op10_suffix_array_dedup, op11_line_dedup, op12_alignment, op13_periodic_runs)}
