"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontaminate, languages, licenses, mixing, ngram_join, pages, paragraphs, spelling, suffixes, token_ids, toxicity,
    vectors, whitening,
)
from millrace.llm.frames import reach_workers, read, split_of
from millrace.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Query) -> Query:
    def ready(spark: SparkSession, sf: str) -> DataFrame:
        reach_workers(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = ready
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    taken = mixing.plan(read(spark, sf, "documents"))
    return taken.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    found = languages.predict(documents, languages.train(documents))
    return found.select("doc_id", (split_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op3_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids.round_trip(read(spark, sf, "documents"), tokenizer_path())


@query
def op4_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf, "embeddings"))


@query
def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "pages")
    return pages.main_texts(table, pages.train(table))


@query
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffixes.remove_repeats(read(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(read(spark, sf, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op9_paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = paragraphs.remove_near_copies(read(spark, sf, "documents"))
    return kept.select(
        "doc_id", "n_paragraphs", "n_removed", F.col("removed").alias("removed_paragraphs"), "keepers",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    model = toxicity.train(documents, read(spark, sf, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select(
        "doc_id", (split_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(read(spark, sf, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(of)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        labels("labels").alias("labels"), "score", "expressions",
    )


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.noisy_words(read(spark, sf, "documents")))


@query
def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.per_component(whitening.whiten(read(spark, sf, "embeddings")))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


def oracles() -> dict[str, str]:
    found = {name: sql for name, sql in ORACLES.items() if name in QUERIES}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
