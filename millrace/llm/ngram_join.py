"""Jaccard self-join of documents on five-word shingles by chosen paths.

Every set samples its own tokens (shingles) by hash: in a run a token is chosen if its hash lies below
1 / (similarity * set size), so two similar sets are expected to choose at least one common token. Sets that
share a path of chosen tokens share a bucket. A bucket of up to ``SMALL`` sets is compared by brute force; a larger
one is split again on the members' other chosen tokens, to ``DEPTH`` tokens. The runs use independent hashes; their
number follows from the target recall (a run misses a pair at the threshold with probability 1/e, so
``ceil(-ln(1 - recall))`` runs), and small sets choose all their tokens.

Equal sets are one class with a count. In a bucket min-wise sketches decide which members are alike (far below the
threshold); what hangs together that way is a group, and every pair of a group is then compared exactly on the whole
sets, in blocks over many tasks, so neither a bucket nor a group of copies is one task's work and no pair is a row.

Defined cases: null, empty and wordless texts link with nothing; a row with a null doc_id is left out of the result
(it cannot be named); rows with equal doc_id count as one document when their sets are equal, else each set is a
document of that id and the results of the id are merged (smallest component, most links); no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S
from millrace.llm.bytesets import mix
from millrace.llm.components import components
from millrace.llm.frames import cut, tidy_shuffles, up_to_bound

RECALL = 0.9999
SMALL = 64
DEPTH = 3
FURTHER = 2  # tokens on which a member of a large bucket moves on, in each of the buckets it is in
ALIKE = 0.55  # share of sketch places; 64 places at similarity 0.8 fall below it about once in 10^6
BROADCAST_ROWS = 2_000_000


def chosen(grams: np.ndarray, offsets: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens each set chooses over all runs, end to end, with offsets."""
    runs = max(1, math.ceil(-math.log(1 - recall)))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bound = np.minimum(1.0, 1.0 / (least * np.maximum(sizes, 1)))
    below = np.where(bound >= 1, 2.0**64, bound * 2.0**64)[owner]
    picked, whose = [], []
    for run in range(runs):
        drawn = mix(grams ^ np.uint64((run + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        got = np.flatnonzero(drawn.astype(np.float64) < below)
        picked.append(grams[got])
        whose.append(owner[got])
    picked, whose = np.concatenate(picked), np.concatenate(whose)
    order = np.lexsort((picked, whose))
    picked, whose = picked[order], whose[order]
    if len(picked):
        fresh = np.r_[True, (picked[1:] != picked[:-1]) | (whose[1:] != whose[:-1])]
        picked, whose = picked[fresh], whose[fresh]
    return picked, np.r_[0, np.cumsum(np.bincount(whose, minlength=len(sizes)))]


def features(documents: DataFrame, least: float, recall: float) -> DataFrame:
    """Per row: doc_id, the set's code and size, its chosen tokens and its sketch."""

    def fn(rows: pa.RecordBatch, grams: np.ndarray, where: np.ndarray) -> list:
        one, two = S.set_codes(grams, where)
        tokens, ends = chosen(grams, where, least, recall)
        sk = S.sketches(grams, where)
        return [
            rows.column(0), S.int64(one), S.int64(two), S.int64(np.diff(where)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), S.int64(tokens)),
            S.binary(sk.ravel(), np.arange(len(sk) + 1) * sk.shape[1]),
        ]

    source = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return S.per_text(source, 1, "doc_id long, one long, two long, size long, tokens array<long>, sketch binary", fn)


def _buckets(reps: DataFrame) -> list[DataFrame]:
    """(bucket, id) of the small buckets along the chosen paths, level by level."""
    done = []
    paths = reps.select("id", "tokens", F.explode("tokens").alias("bucket"))
    for level in range(DEPTH):
        last = level == DEPTH - 1
        counts = cut(
            paths.groupBy("bucket").agg(
                F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("id")).alias("_who"), F.min("id").alias("_low")
            ).filter("_n > 1"), "buckets",
        )
        small = counts if last else counts.filter(F.col("_n") <= SMALL)
        # Alike sets share many buckets; of buckets with the same members one is enough.
        small = small.groupBy("_n", "_who", "_low").agg(F.min("bucket").alias("bucket"))
        done.append(paths.join(small.select("bucket"), "bucket").select("bucket", "id"))
        large = counts.filter(F.col("_n") > SMALL).select("bucket")
        if last or large.isEmpty():
            break
        inside = paths.join(up_to_bound(large, BROADCAST_ROWS), "bucket")
        # The same few tokens for any two similar members: those with the smallest hash under this path.
        further = F.slice(
            F.array_sort(F.transform("tokens", lambda t: F.struct(F.xxhash64("bucket", t).alias("h"), t.alias("t")))),
            1, FURTHER,
        )
        paths = cut(
            inside.withColumn("_next", F.explode(further))
            .select("id", "tokens", F.xxhash64("bucket", "_next.t").alias("bucket")).distinct(),
            "paths",
        )
    return done


def join(documents: DataFrame, *, least: float = S.SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, class_id, n_links (other documents linked), component_id, kept."""
    with tidy_shuffles(documents.sparkSession):
        feats = cut(features(documents, least, recall), "features")
        classes = cut(
            feats.filter("size > 0").groupBy("one", "two")
            .agg(F.min("doc_id").alias("id"), F.count_distinct("doc_id").alias("copies")), "classes",
        )
        reps = cut(
            feats.filter("size > 0").join(classes.select("one", "two", "id"), ["one", "two"])
            .filter("doc_id = id").dropDuplicates(["one", "two"]).select("one", "two", "id", "tokens", "sketch"), "reps",
        )
        # A document id can stand for two sets only if its rows differ; the set code names the set.
        named = reps.select(F.col("one").alias("id"), "tokens", "sketch")
        levels = _buckets(named.select("id", "tokens"))
        links = None
        for level in levels:
            rows = S.in_blocks(level, "bucket", S.SKETCH_BLOCK).join(named.select("id", "sketch"), "id")
            found = S.similar_links(rows, ALIKE)
            links = found if links is None else links.unionAll(found)
        groups = components(cut(links, "alike"))
        exact = cut(_exact(documents, classes, groups, least), "exact")
        return cut(_result(feats, classes, exact), "joined")


def _exact(documents: DataFrame, classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Exact links inside the groups, on the sets of one document of each class."""
    wanted = groups.join(classes, groups["id"] == classes["one"]).select(
        classes["id"].alias("doc_id"), F.col("one").alias("want"), "root", "copies"
    )
    wanted = cut(wanted, "wanted")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        up_to_bound(wanted, BROADCAST_ROWS), "doc_id"
    ).select("want", "root", "copies", "text")

    def fn(rows: pa.RecordBatch, grams: np.ndarray, where: np.ndarray) -> list:
        one, _ = S.set_codes(grams, where)
        return [rows.column(0), rows.column(1), rows.column(2), S.int64(one), S.binary(grams, where)]

    sets = cut(
        S.per_text(texts, 3, "id long, root long, copies long, one long, codes binary", fn)
        .filter("id = one").drop("one").dropDuplicates(["id"]), "sets",
    )
    blocks = S.in_blocks(sets.select("root", "id", "copies"), "root").join(sets.select("id", "codes"), "id")
    return S.linked_blocks(blocks, "root", least)


def _result(feats: DataFrame, classes: DataFrame, exact: DataFrame) -> DataFrame:
    roots = components(exact.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # Components were named by set codes; the smallest document of a component names it to the outside.
    links = exact.filter("other is null").groupBy("id").agg(F.sum("links").alias("_links"))
    known = (
        classes.join(links, classes["one"] == links["id"], "left").select(classes["*"], "_links")
        .join(roots.withColumnRenamed("id", "_rid"), F.col("one") == F.col("_rid"), "left")
        .select("one", "two", "id", "copies", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("root", "one").alias("_root"))
    )
    names = known.groupBy("_root").agg(F.min("id").alias("component_id"))
    named = known.join(names, "_root").select(
        "one", "two", F.col("id").alias("class_id"), (F.col("_links") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    merged = feats.select("doc_id", "one", "two").join(named, ["one", "two"], "left")
    own = F.col("doc_id")
    return merged.groupBy("doc_id").agg(
        F.min(F.coalesce("class_id", own)).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.min(F.coalesce("component_id", own)).alias("component_id"),
    ).withColumn("kept", F.col("component_id") == own)


def keep_one(documents: DataFrame, *, least: float = S.SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One document of each component, with all its columns; rows that link with nothing all stay.

    The texts stay where they are unless more than ``BROADCAST_ROWS`` documents go.
    """
    drop = join(documents, least=least, recall=recall).filter("not kept").select(F.col("doc_id").alias("_drop"))
    return documents.join(up_to_bound(drop, BROADCAST_ROWS), documents["doc_id"] == drop["_drop"], "left_anti")
