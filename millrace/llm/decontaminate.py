"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Of every ``SPAN`` words in
a row, the smallest of the hashes of its ``GRAM``-word grams is a fingerprint, so two texts that share
``SPAN`` words in a row share a fingerprint. Documents holding a fingerprint of the benchmark are the
candidates; their windows of ``SPAN`` words are then compared word by word with the items' windows, which
extends a hit to every shared window and drops chance hits of a gram or hash.

An item of fewer than ``SPAN`` words is one window of its own length and is looked up in every document.

Defined cases: null text has no words; an item without words or with a null item_id is ignored; repeated
rows of a document give equal rows; an empty benchmark leaves every document clean. Other columns of either
table are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut, tidy_shuffles, up_to_bound

SPAN = 10
GRAM = 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of distinct benchmark fingerprints or windows that may be broadcast (about 16 or 100 bytes each).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text, only A-Z lower-cased (``lower`` does the same to pure ASCII, and faster)."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def _upto(last: Column) -> Column:
    """0..last, empty when ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _unfold(array: Column | str) -> Column:
    """``explode`` of a computed array. The outer form, as the inner one makes Spark push the filter
    ``size(array) > 0`` below the projections and so compute the whole array again inside that filter."""
    return F.explode_outer(array)


def with_fingerprints(df: DataFrame, words: str, out: str, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Add the distinct winnowed fingerprints of the word array."""
    width = span - gram + 1
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_g",
        F.transform(_upto(F.size("_h") - gram), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(gram)])),
    )
    mins = F.transform(_upto(F.size("_g") - width), lambda i: F.least(*[F.get("_g", i + j) for j in range(width)]))
    return df.withColumn(out, F.array_distinct(mins)).drop("_h", "_g")


def _windows(df: DataFrame, length: int) -> DataFrame:
    """One row per window of ``length`` words: its first position and its text."""
    spans = F.transform(
        _upto(F.size("_w") - length),
        lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i + 1, length), " ").alias("window")),
    )
    keep = [c for c in df.columns if c != "_w"]
    unfolded = df.select(*keep, _unfold(spans).alias("_s")).filter("_s is not null")
    return unfolded.select(*keep, "_s.at", "_s.window")


def find_windows(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Written table (doc_id, text_code, item_id, at, length): every occurrence of an item's window."""
    spark = documents.sparkSession
    with tidy_shuffles(spark):
        docs = documents.select("doc_id", F.xxhash64("text").alias("text_code"), "text")
        items = cut(
            benchmark.filter("item_id is not null").select("item_id", words_of(F.col("text")).alias("_w"))
            .filter(F.size("_w") > 0), "items",
        )
        lengths = [r[0] for r in items.select(F.least(F.size("_w"), F.lit(span)).alias("n")).distinct().collect()]
        found = []
        for length in sorted(lengths):  # at most ``span`` of them
            if length == span:
                marks = cut(
                    with_fingerprints(items.filter(F.size("_w") >= span), "_w", "_f", span=span, gram=gram)
                    .select(_unfold("_f").alias("mark")).filter("mark is not null").distinct(), "marks",
                )
                held = with_fingerprints(
                    docs.select("doc_id", "text_code", words_of(F.col("text")).alias("_w")), "_w", "_f",
                    span=span, gram=gram,
                ).select("doc_id", "text_code", _unfold("_f").alias("mark")).filter("mark is not null")
                candidates = cut(
                    held.join(up_to_bound(marks, BROADCAST_ROWS), "mark", "left_semi")
                    .select(F.col("doc_id").alias("_id"), F.col("text_code").alias("_tc")).distinct(), "candidates",
                )
                near = docs.join(
                    candidates,
                    docs["doc_id"].eqNullSafe(candidates["_id"]) & docs["text_code"].eqNullSafe(candidates["_tc"]),
                    "left_semi",
                )
                targets = items.filter(F.size("_w") >= span)
            else:
                near, targets = docs, items.filter(F.size("_w") == length)
            wanted = cut(_windows(targets, length).select("item_id", "window").distinct(), "windows")
            spans = _windows(near.select("doc_id", "text_code", words_of(F.col("text")).alias("_w")), length)
            found.append(
                spans.join(up_to_bound(wanted, BROADCAST_ROWS), "window")
                .select("doc_id", "text_code", "item_id", "at", F.lit(length).alias("length"))
            )
        if not found:
            return spark.createDataFrame([], "doc_id long, text_code long, item_id long, at int, length int")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return cut(out.distinct(), "hits")


def report(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: its words, how many are hit, by how many items, and their digest."""
    hits = find_windows(documents, benchmark, span=span, gram=gram)
    per_doc = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_code").alias("_tc")).agg(
        F.collect_set(F.struct("at", "length")).alias("_spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("_items"),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    )
    summed = per_doc.select(
        "_id", "_tc", F.size(covered).cast("long").alias("_hit"), F.size("_items").cast("long").alias("_n"),
        F.array_join(F.array_sort("_items"), ",").alias("_list"),
    )
    docs = documents.select(
        "doc_id", F.xxhash64("text").alias("_code"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
    )
    joined = docs.join(
        summed, docs["doc_id"].eqNullSafe(summed["_id"]) & docs["_code"].eqNullSafe(summed["_tc"]), "left"
    )
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("_list", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Documents without any window of the benchmark, with all their columns.

    The texts stay where they are unless more than ``BROADCAST_ROWS`` documents go.
    """
    hits = find_windows(documents, benchmark, span=span, gram=gram)
    bad = cut(hits.select(F.col("doc_id").alias("_id"), F.col("text_code").alias("_tc")).distinct(), "bad")
    on = documents["doc_id"].eqNullSafe(bad["_id"]) & F.xxhash64(documents["text"]).eqNullSafe(bad["_tc"])
    return documents.join(up_to_bound(bad, BROADCAST_ROWS), on, "left_anti")
