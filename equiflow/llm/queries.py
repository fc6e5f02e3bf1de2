"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html, jaccard_join, mixing, packing, repeats, secrets, spotsigs, toxicity, urls
from .common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer_path(), words=300_000)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: Below this the likeness of two fingerprints counts as none, so sets of very different length aren't compared.
LEAST_LIKENESS = 0.05


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text and the next text, and how alike they are.

    A null text is empty; rows with one id are ordered by their texts, null ids come last; an empty
    table gives no rows.
    """
    df = spotsigs.with_next(documents(spark, sf_dir))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS int))"), F.expr("substring(next_text, 1, CAST(floor(length(text) / 3) AS int))")))
    for text, out in (("text", "spots"), ("edited", "edited_spots"), ("next_text", "next_spots")):
        df = spotsigs.with_spots(df, text, out)
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("spots")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        spotsigs.pruned_likeness(F.col("spots"), F.col("edited_spots"), LEAST_LIKENESS).alias("near_edited"),
        spotsigs.pruned_likeness(F.col("spots"), F.col("next_spots"), LEAST_LIKENESS).alias("near_next"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets.scan_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return df.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repeats.remove_repeats(documents(spark, sf_dir))
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_spotsigs, op3_secret_scan, op4_repeated_bytes, op5_mixing, op6_html_extraction, op7_toxicity, op8_url_filter, op9_exact_dedup, op10_jaccard_join)
}

ORACLES = {
    "op5_mixing": mixing.ORACLE,
    "op8_url_filter": urls.oracle(),
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
}
