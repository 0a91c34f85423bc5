"""The registered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliquora.llm import embedding_dedup, html_extraction, media_columns, merkle, mixing, packing, quality_rules, ranked_search, secret_scans, simhash, substring_dedup, toxicity, url_filters
from cliquora.llm.common import durable, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_of(spark: SparkSession, sf_dir: str) -> list[quality_rules.Rule]:
    """The decision list that the labelled documents give."""
    return quality_rules.learn(quality_rules.labelled_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def secrets_of(spark: SparkSession, sf_dir: str) -> secret_scans.Models:
    return secret_scans.train(secret_scans.labelled_samples(spark, table(spark, sf_dir, "documents")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), quality_of(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.describe(media_columns.store_telephony(table(spark, sf_dir, "documents"), "text"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.scan(table(spark, sf_dir, "documents"), secrets_of(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(documents, model)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is drawn from the table itself: every domain whose own label has a hyphen."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(pages, durable(url_filters.hyphenated(pages)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"), html_extraction.train())


#: Words from which op8 takes a run of repeated units for a passage: one of 50 words loses up to a unit's length at either end.
PASSAGE = 30


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed passage: whose it is, where, how many words, and the document that keeps its beginning.

    A passage is a run of PASSAGE words or more. Shorter runs (licence lines, greetings, two or three frequent words) stay here,
    as they stand in nearly every document; the operator itself removes them unless min_words says otherwise.
    """
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), min_words=PASSAGE)
    return spans.select("doc_id", "start", "end", F.col("words").alias("n_words"), F.col("keeper").alias("kept_doc_id"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.leaves(table(spark, sf_dir, "documents"), merkle.tampered_text()))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_media_columns, op3_secret_scans, op4_toxicity, op5_mixing, op6_url_filters, op7_html_extraction, op8_substring_dedup, op9_packing, op10_simhash, op11_embedding_dedup, op12_merkle_manifest, op13_ranked_search)}
ORACLES = {"op5_mixing": mixing.ORACLE, "op6_url_filters": url_filters.ORACLE, "op11_embedding_dedup": embedding_dedup.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
