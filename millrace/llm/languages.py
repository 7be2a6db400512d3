"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of order 0 to 3, with frozen counts. A byte seen in its longest known context
costs -log2(c / (n + d)) bits (n visits, d different bytes after it: escape method C); a byte not seen there costs the
escape, -log2(d / (n + d)), and is coded one order lower, down to equal chances for all symbols. The language whose tree
codes the whole text in the fewest bits is predicted.

Because the counts are frozen, the cost of a byte depends on itself and three bytes before it, so the walk down the
orders is solved once per tree: orders up to 2 are a dense table, and the most visited order-3 contexts have rows of
their own. Scoring a text is two table lookups per byte.

Training reads a bounded sample: per language at most ``TRAIN_DOCS`` documents of at most ``TRAIN_BYTES`` bytes, by a hash of
the id; where these are too few, the shortest of the longer ones are added while a language holds at most ``TRAIN_BYTES`` bytes
a document, and one in any case. Bytes beyond the ``SYMBOLS`` - 1 most frequent share one symbol. Scoring reads every whole text.

Defined cases: a null or letterless text is ``und`` with score 0; a row without lang never trains; with no training row
every text is ``und``; equal code lengths fall to the first language in order; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytesets import pieces, text_buffer, tidy
from millrace.llm.frames import split_of

TRAIN_DOCS = 400
TRAIN_BYTES = 16_384
SYMBOLS = 128
CONTEXTS = 65_536  # order-3 rows over all languages
MIN_VISITS = 8
SURE = 64  # bytes of evidence after which the score stops growing
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    symbol: np.ndarray = field(default_factory=lambda: np.zeros(256, np.int32))
    #: (symbols^3, languages) bits after two symbols, and (rows, symbols, languages) bits after three.
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    deep: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0), np.float32))
    row_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


def _bits(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bits of each symbol (last axis) in contexts with these counts, escaping to ``lower``."""
    n = counts.sum(-1, keepdims=True)
    d = (counts > 0).sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = -np.log2(counts / (n + d))
        escape = -np.log2(d / (n + d)) + lower
    return np.where(counts > 0, seen, np.where(n > 0, escape, lower)).astype(np.float32)


def _history(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The symbols one, two and three places back (0 before the start of a text)."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    back, out = symbols, []
    for _ in range(3):
        back = np.r_[np.int32(0), back[:-1]]
        back[starts] = 0
        out.append(back)
    return tuple(out)


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Trees of every language from its sample texts."""
    languages = sorted(k for k, texts in samples.items() if any(texts))
    if not languages:
        return Model()
    s = SYMBOLS
    usage = sum(np.bincount(np.frombuffer(b"".join(samples[k]), np.uint8), minlength=256) / max(1, sum(map(len, samples[k]))) for k in languages)
    symbol = np.zeros(256, np.int32)
    top = [b for b in np.argsort(-usage, kind="stable")[: s - 1] if usage[b] > 0]
    symbol[top] = np.arange(1, len(top) + 1)
    grams = []
    for k in languages:
        raw = symbol[np.frombuffer(b"".join(samples[k]), np.uint8)]
        one, two, three = _history(raw, np.r_[0, np.cumsum([len(t) for t in samples[k]])])
        grams.append((((three * s + two) * s + one), raw))
    visits = sum(np.bincount(g, minlength=s**3) for g, _ in grams)
    known = np.flatnonzero(visits >= MIN_VISITS)
    known = np.sort(known[np.argsort(-visits[known], kind="stable")[: CONTEXTS // len(languages)]])
    row_of = np.full(s**3, -1, np.int32)
    row_of[known] = np.arange(len(known))
    dense, deep = [], []
    for ctx, raw in grams:
        zero = np.bincount(raw, minlength=s)
        first = np.bincount((ctx % s) * s + raw, minlength=s * s).reshape(s, s)
        second = np.bincount((ctx % (s * s)) * s + raw, minlength=s**3).reshape(s, s, s)
        low = _bits(zero, np.full(s, np.log2(s)))
        low = _bits(first, low[None, :])
        low = _bits(second, low[None, :, :])
        dense.append(low.reshape(-1))
        at = row_of[ctx]
        third = np.bincount(at[at >= 0] * s + raw[at >= 0], minlength=len(known) * s).reshape(len(known), s)
        deep.append(_bits(third, low.reshape(s * s, s)[known % (s * s)]))
    return Model(languages, symbol, np.stack(dense, -1), np.stack(deep, -1), row_of)


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages) bits of each whole text under each tree."""
    s = SYMBOLS
    symbols = model.symbol[raw]
    one, two, three = _history(symbols, offsets)
    near = (two * s + one) * s + symbols
    cost = model.dense[near]
    if len(model.deep):
        row = model.row_of[(three * s + two) * s + one]
        at = np.flatnonzero(row >= 0)
        cost[at] = model.deep.reshape(-1, len(model.languages))[row[at] * s + symbols[at]]
    sums = np.zeros((len(raw) + 1, cost.shape[1]))
    np.cumsum(cost, axis=0, out=sums[1:], dtype=np.float64)
    return sums[offsets[1:]] - sums[offsets[:-1]]


def train(documents: DataFrame, *, fold: int = 3, held_out: int = 1) -> Model:
    """Fit on documents with a language whose id does not fall into the held-out remainder."""
    usable = documents.select("doc_id", "lang", F.octet_length("text").alias("_n")).filter(
        (F.col("_n") > 0) & F.col("lang").isNotNull() & (split_of("doc_id", fold) != held_out)
    )
    length = F.when(F.col("_n") > TRAIN_BYTES, F.col("_n")).otherwise(0)  # long texts come last, the shortest of them first
    order = Window.partitionBy("lang").orderBy(length, F.xxhash64(F.lit("languages"), "doc_id"), "doc_id")
    place = F.row_number().over(order)
    # At most TRAIN_DOCS ids per language: Spark limits each task's part before the shuffle.
    picked = usable.select("doc_id", "lang", "_n", place.alias("_p")).filter(F.col("_p") <= TRAIN_DOCS)
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("_bytes", before).filter((F.col("_p") == 1) | (F.col("_bytes") <= TRAIN_DOCS * TRAIN_BYTES))
    ids = picked.groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).agg(F.max("_n").alias("_most"))
    rows = (
        documents.select("doc_id", "lang", "text")
        .join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .filter(F.octet_length("text") <= F.greatest(F.lit(TRAIN_BYTES), "_most"))
        .select("lang", "text").distinct().collect()
    )
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return fit(samples)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) of every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by SYMBOLS, CONTEXTS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets, 1 << 20):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = np.diff(at)
                letters = np.r_[0, np.cumsum(_LETTER[part])]
                lettered = letters[at[1:]] > letters[at[:-1]]
                for k in np.flatnonzero(~lettered & (n > 0)):
                    lettered[k] = _has_letter(part[at[k] : at[k + 1]].tobytes())
                best, score, bits = np.full(j - i, len(m.languages)), np.zeros(j - i), np.zeros(j - i)
                if m.languages and len(part):
                    cost = code_lengths(m, part, at)
                    scaled = -np.log(2) * cost * (np.minimum(n, SURE) / np.maximum(n, 1))[:, None]
                    odds = np.exp(scaled - scaled.max(1, keepdims=True))
                    best = np.where(lettered, cost.argmin(1), best)
                    score = np.where(lettered, odds.max(1) / odds.sum(1), 0.0)
                    bits = cost.min(1) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(bits)],
                    [key, "lang_pred", "score", "bits_per_byte"],
                )

    source = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return source.mapInArrow(tidy(run), f"`{key}` long, lang_pred string, score double, bits_per_byte double")
