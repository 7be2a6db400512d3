"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by (source, key), a distributed prefix sum
of their word counts runs through each source, and each source is cut at its exact budget: whole epochs
first, then the documents in front of the cut, the last of them in part.

Targets: sources share ``share`` times all words by weight; a source stops at ``most`` times its own words and
the excess is shared again by weight until none is above. Sorting sources by (capacity / weight) makes that
a prefix sum too: the capped sources are a prefix of that order.

Defined cases: null text has size 0; the null source is a source of its own, last in order; a source without
words has target 0 and takes nothing; rows equal in every used column are interchangeable, so reruns agree;
empty input gives an empty result. Other columns are not read by ``plan`` and are kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut, tidy_shuffles
from millrace.plans.ordered import number_rows, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    placed = number_rows(totals, [F.col("source").isNull(), F.col("source")], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.col("_place") - 1) % len(weights)) + 1).cast("int"))
    placed = placed.select(
        "source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    laid = cut(
        running(placed, [], ["_ratio", F.col("source").isNull(), F.col("source")], sums={"_caps": "_cap", "_light": "_weight"}),
        "ratios",
    )
    whole = laid.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_weights"))
    # Level if exactly the sources before this one were capped: the right one is the first it does not exceed.
    level = (F.col("_all") * share - (F.col("_caps") - F.col("_cap"))) / (F.col("_weights") - (F.col("_light") - F.col("_weight")))
    levels = laid.crossJoin(F.broadcast(whole)).select(level.alias("_level"), "_ratio")  # ``whole`` is one row
    chosen = levels.filter(F.col("_level") <= F.col("_ratio")).agg(F.min_by("_level", "_ratio").alias("_level"))
    return laid.crossJoin(F.broadcast(chosen)).select(
        "source", "source_size",
        F.when(F.col("_level").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight"))).alias("target"),
    )


def plan(
    documents: DataFrame, *, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(doc_id, source, text_code, size, source_size, target, taken) of every row."""
    with tidy_shuffles(documents.sparkSession):
        sized = cut(
            documents.select(
                "doc_id", "source", F.xxhash64("text").alias("text_code"),
                F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            ).withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_code")),
            "sizes",
        )
        goals = cut(targets(sized, weights=weights, share=share, most=most), "targets")
        summed = running(sized, ["source"], ["_key", "doc_id", "text_code", "size"], sums={"_upto": "size"})
        return cut(_taken(summed, goals), "mix")


def _taken(summed: DataFrame, goals: DataFrame) -> DataFrame:
    goals = goals.withColumnRenamed("source", "_goal")
    joined = summed.join(goals, summed["source"].eqNullSafe(goals["_goal"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = (budget - epochs * F.col("source_size")) - (F.col("_upto") - F.col("size"))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return joined.select(
        "doc_id", "source", "text_code", "size", "source_size", "target",
        (epochs * F.col("size") + extra).cast("long").alias("taken"),
    )


def mixed(documents: DataFrame, *, seed: str = "mix") -> DataFrame:
    """The mix itself: each document once per epoch it is in, the one at the cut with its first words only.

    A cut text is its first words joined by single spaces. Equal rows share evenly what they took together.
    Documents without words take nothing and are not in the mix.
    """
    columns = documents.columns
    plans = (
        plan(documents, seed=seed).filter("taken > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("text_code").alias("_tc"))
        .agg(F.first("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    )
    coded = documents.withColumn("_code", F.xxhash64("text"))
    joined = coded.join(
        plans,
        coded["doc_id"].eqNullSafe(plans["_id"]) & coded["source"].eqNullSafe(plans["_src"])
        & (coded["_code"] == plans["_tc"]),
    )
    each = F.floor(F.col("_taken") / F.col("_rows"))
    joined = joined.withColumn("_whole", F.floor(each / F.col("_size")).cast("int")).withColumn(
        "_left", each - F.col("_whole") * F.col("_size")
    )
    copies = joined.withColumn(
        "_part",
        F.explode(F.concat(
            F.array_repeat(F.col("_size"), F.col("_whole")),
            F.when(F.col("_left") > 0, F.array(F.col("_left"))).otherwise(F.array().cast("array<bigint>")),
        )),
    )
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_part").cast("int")), " ")
    text = F.when(F.col("_part") < F.col("_size"), first).otherwise(F.col("text"))
    out = {c: F.col(c) for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_part") < F.col("_size"), F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return copies.select(*[out[c].alias(c) for c in columns])
