"""The registered queries of the operators: each over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import (
    decontaminate,
    divergence,
    embedding_links,
    html_text,
    maxent,
    ngram_join,
    pieces,
    pii,
    quality,
    token_counts,
    toxicity,
    url_filter,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from rows that are not held out."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of a test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words(names["runs"])
    return found.select(
        "doc_id",
        F.col(names["words"]).alias("n_words"),
        hit.alias("n_hit"),
        F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names["items"], ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document: by fixed patterns, and added by trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs).drop("text", "redacted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files made of the documents."""
    return token_counts.document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates and number of links of every document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    return pieces.token_digests(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector within its label."""
    found = embedding_links.neighbours(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from rows that are not held out."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector in the components of largest variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from rows that are not held out."""
    return maxent.score_texts(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that a source overuses."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontamination,
        op3_pii,
        op4_token_counts,
        op5_ngram_jaccard_join,
        op6_sentencepiece,
        op7_embedding_near_dedup,
        op8_quality,
        op9_html_extraction,
        op10_url_filter,
        op11_embedding_whitening,
        op12_lm_scoring,
        op13_source_divergence,
    )
}
