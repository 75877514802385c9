"""The queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_index, html_text, mixing, ordinal_quality, ppm, quality_rules, simhash, suffix_dedup, url_filters, warc_zip
from .common import word_count

#: The fixed rules of op10.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text by the model of the texts that are not held out; null texts are empty, null ids count as an empty text for the split, repeated rows are scored each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    scored = ppm.score_corpus(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of every row; null texts count zero words, null sources are one source and the last, repeated rows are documents each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), F.col("words"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mix_size")).alias("taken"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to packages and read the records back; null html is empty, null ids come last, rows equal in id and payload are responses each."""
    packages = warc_zip.write_packages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc_zip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 neither."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.train(docs, labels.select("doc_id", grade.alias("grade")), top=2)
    return ordinal_quality.score(docs, model).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every row by base rules and by cutoffs learned from all labels; null texts have no words, null languages are a stratum."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = quality_rules.measure(docs).drop("text").checkpoint()
    cutoffs = quality_rules.learn_cutoffs(measured, _table(spark, sf_dir, "labels")).checkpoint()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(measured, cutoffs).select(*columns)


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside windows of test items, for every row; null texts and items have no words, items with null ids are one item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.contamination(docs, _table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.col("n_hit") > 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row and the smallest id that links reach; texts without words have fingerprint zero, null ids are never the smallest."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html and pages without main text give an empty text, repeated rows stay."""
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated strings of 400 bytes; null texts are empty, repeated rows are occurrences each."""
    return suffix_dedup.repeat_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url; null urls and urls without :// have an empty host and path, repeated rows count each."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ppm, op2_mixing, op3_warc_zip, op4_ordinal_quality, op5_quality_rules, op6_fm_index, op7_simhash, op8_html_text, op9_suffix_dedup, op10_url_filters)}
