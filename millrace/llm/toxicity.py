"""Toxicity by compression distance.

Two zstandard dictionaries are made of words of labelled text (not by zstandard's own training, see README). The ordinary one holds the words ordinary
documents use most. The toxic one is the ordinary one plus the words of toxic documents around byte
segments that toxic documents use far more often than ordinary ones. A text is cut into short windows
between words, each window is compressed under both, and what the toxic dictionary saves per window is
the evidence. A logistic threshold over a text's largest savings is calibrated on labelled documents
that did not train the dictionaries.

Training reads a bounded sample of whole texts (``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` labelled documents, chosen by a hash
of the id among those of at most ``TRAIN_BYTES`` bytes; where these are too few, the shortest of the longer ones are added
while a class holds at most ``TRAIN_BYTES`` bytes a document, and one in any case). The classes are counted over all training
labels that have a text, and the intercept is set to their true shares. Scoring reads every whole text.

Defined cases: a null or empty text, or one without a word, has no window and gets the calibrated score
of "no evidence". A label row with null doc_id or null toxic is not used; a document with several label
rows counts as toxic if one says so. With no labelled toxic or no ordinary document every score is 0.
Repeated rows are scored alike. Other columns are untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import tidy
from millrace.llm.frames import cut, split_of

TRAIN_TOXIC = 1_500
TRAIN_ORDINARY = 4_500
TRAIN_BYTES = 16_384
SEGMENT = 5
WINDOW = 64
ORDINARY_BYTES = 30_000
TOXIC_BYTES = 12_000
MIN_EVIDENCE = 50.0  # log-likelihood ratio a segment needs before it counts as toxic
MIN_RATIO = 8.0

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def folded(text: bytes) -> bytes:
    """Lower-case ASCII words between single spaces, with one space at either end."""
    words = text.translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole text in windows that end at the first space after ``size`` bytes."""
    body, i = folded(text), 0
    while i < len(body) - 1:
        j = body.find(b" ", i + size)
        j = len(body) - 1 if j < 0 else j
        yield body[i : j + 1]
        i = j


def _evidence(hits: int, misses: int, toxic: int, ordinary: int) -> float:
    """Log-likelihood ratio of a segment's document counts under one rate against two."""
    both = hits + misses
    want = both * toxic / (toxic + ordinary), both * ordinary / (toxic + ordinary)
    return 2 * sum(k * math.log(k / e) for k, e in zip((hits, misses), want) if k)


@dataclass
class Model:
    """Dictionary contents and the calibrated weights; small, and sent to tasks as it is."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    shift: list[float] = field(default_factory=list)

    @property
    def trained(self) -> bool:
        return bool(self.weights)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Scorer:
    """Compressors of a model, built once per task."""

    TOP = 3

    def __init__(self, model: Model) -> None:
        self.model = model
        self.plain = _compressor(model.ordinary).compress
        self.harsh = _compressor(model.ordinary + model.toxic).compress

    def features(self, text: bytes) -> list[float]:
        best: list[int] = [0] * self.TOP
        total, count = 0, 0
        for w in windows(text):
            saved = len(self.plain(w)) - len(self.harsh(w))
            count += 1
            if saved > 2:
                total += saved - 2
                if saved > best[-1]:
                    best = sorted([*best[:-1], saved], reverse=True)
        length = math.log1p(count)
        return [*[float(min(b, 12)) for b in best], math.sqrt(total), length, best[0] * length, total / (1 + count)]

    def score(self, text: bytes) -> float:
        x = (np.array(self.features(text)) - self.model.shift[0::2]) / np.array(self.model.shift[1::2])
        z = float(np.dot(x, self.model.weights[1:]) + self.model.weights[0])
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    bodies = [[folded(t) for t in group] for group in (toxic, ordinary)]
    seen = [Counter(), Counter()]
    words = [Counter(), Counter()]
    for group, segments, used in zip(bodies, seen, words):
        for body in set(group):  # a copied document is one piece of evidence
            segments.update({body[i : i + SEGMENT] for i in range(len(body) - SEGMENT + 1)})
            used.update(set(body.split()))
    nt, no = max(1, len(set(bodies[0]))), max(1, len(set(bodies[1])))

    def telling(hits: int, misses: int, least: float) -> bool:
        return hits / nt > MIN_RATIO * misses / no and _evidence(hits, misses, nt, no) > least

    least = min(MIN_EVIDENCE, 0.8 * nt)
    marks = {s for s, c in seen[0].items() if telling(c, seen[1][s], least)}
    picked = [
        w for w, c in sorted(words[0].items(), key=lambda x: (x[1], x[0]))
        if c >= 2 and c / nt > MIN_RATIO * words[1][w] / no
        and any((b" %b " % w)[i : i + SEGMENT] in marks for i in range(max(1, len(w) + 3 - SEGMENT)))
    ]
    common = [w for w, _ in sorted(words[1].items(), key=lambda x: (-x[1], x[0]))[:8_000]]
    base = (b" " + b" ".join(reversed(common)) + b" ")[-ORDINARY_BYTES:]
    return base, (b" ".join(picked) + b" ")[-TOXIC_BYTES:] if picked else b""


def _calibrate(rows: np.ndarray, wanted: np.ndarray) -> tuple[list[float], list[float]]:
    """Ridge logistic regression by Newton steps over standardised features."""
    mean, spread = rows.mean(0), rows.std(0)
    spread[spread == 0] = 1.0
    x = np.hstack([np.ones((len(rows), 1)), (rows - mean) / spread])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - wanted) + ridge @ w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist(), np.stack([mean, spread], 1).ravel().tolist()


def fit(groups: list[list[bytes]], totals: tuple[int, int]) -> Model:
    """Model of sampled (toxic, ordinary) texts; ``totals`` are the classes' sizes before sampling."""
    if not groups[0] or not groups[1]:
        return Model()
    # Two halves: each calibrates the dictionaries of the other; the final ones use all of it.
    found: list[list[float]] = []
    wanted: list[int] = []
    for half in (0, 1):
        scorer = Scorer(Model(*_dictionaries(*[g[half::2] or g for g in groups])))
        for side, g in ((1, groups[0]), (0, groups[1])):
            for t in g[1 - half :: 2]:
                found.append(scorer.features(t))
                wanted.append(side)
    if len(set(wanted)) < 2:
        return Model()
    weights, shift = _calibrate(np.array(found), np.array(wanted, float))
    # The classes are sampled apart: take the sample's odds out of the intercept and put the true ones in.
    weights[0] += math.log(totals[0] / totals[1]) - math.log(sum(wanted) / (len(wanted) - sum(wanted)))
    return Model(*_dictionaries(*groups), weights, shift)


def train(documents: DataFrame, labels: DataFrame, *, fold: int = 5, held_out: int = 0) -> Model:
    """Fit on labelled documents whose id does not fall into the held-out remainder."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(split_of("doc_id", fold) != held_out)
        .groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("_toxic"))
    )
    texts = documents.select("doc_id", F.octet_length("text").cast("long").alias("_size")).filter("_size is not null")
    sized = cut(known.join(texts.groupBy("doc_id").agg(F.max("_size").alias("_size")), "doc_id"), "labelled")
    totals = {r["_toxic"]: r["n"] for r in sized.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: list[tuple[int, int]] = []
    for flag, n in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)):
        drawn = (
            sized.filter(F.col("_toxic") == flag)
            .orderBy(F.when(F.col("_size") > TRAIN_BYTES, F.col("_size")).otherwise(0), F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id")
            .limit(n).collect()
        )
        used = 0
        for r in drawn:
            used += r["_size"]
            if used > n * TRAIN_BYTES and used > r["_size"]:  # only long texts come to this
                break
            chosen.append((r["doc_id"], flag))
    if len(totals) < 2:
        return Model()
    picked = documents.sparkSession.createDataFrame(chosen, "doc_id long, _toxic int")
    rows = (
        documents.select("doc_id", "text").filter("text is not null")
        .join(F.broadcast(picked), "doc_id").select("doc_id", "_toxic", "text")
        .dropDuplicates(["doc_id", "text"]).limit(2 * (TRAIN_TOXIC + TRAIN_ORDINARY)).collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    data = [(r["_toxic"], r["text"].encode("utf-8", "surrogatepass")) for r in rows]
    return fit([[t for flag, t in data if flag == side] for side in (1, 0)], (totals[1], totals[0]))


def _scores(texts: pa.Array, scorer: Scorer | None) -> np.ndarray:
    if scorer is None:
        return np.zeros(len(texts))
    return np.fromiter(
        (scorer.score(t.as_py() or b"") for t in texts.cast(pa.large_binary())), float, len(texts)
    )


def score(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    source = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.trained else None
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), scorer))], [key, "score"])

    return source.mapInArrow(tidy(run), f"`{key}` long, score double")


def keep_ordinary(documents: DataFrame, model: Model, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows whose text scores below ``limit``, with all their columns."""
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.trained else None
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), scorer) < limit))

    return documents.mapInArrow(tidy(run), documents.schema)
