"""Paragraph dedup: MinHash banding, exact verification, removal by components.

Lines do not make paragraphs here: a passage may run over several short lines or stand inside a long one, and short
stock lines repeat everywhere. A paragraph is a line or, of a longer line, a stretch cut where the text itself says
so: before each word whose two-word code is the smallest of the ``REACH`` words on either side, all of that line.
Equal passages are therefore cut alike whatever stands around them, as long as their lines break alike (a passage set
in other lines is met only where a cut of its own and a line's end agree). Paragraphs with equal shingle sets are one class. The min-wise sketch of a class is cut into bands;
``bands`` picks the longest band that still finds a pair at the threshold with the wanted recall. Classes that share a
band value hang together as a group; inside a group every pair is compared exactly (Jaccard of five-word shingles), in
blocks over many tasks. Of each component of links the first paragraph (doc_id, then place) stays; the others are
copies. A run of copies next to each other is removed if it has ``LEAST_RUN`` words or more, so stock phrases stay.

Defined cases: a null text has no paragraph, an empty text and a text without words have one, which stays; paragraphs
of fewer than five words have no shingle and are never copies; rows with an equal doc_id are told apart as in
``suffixes``; a null doc_id sorts first; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S
from millrace.llm.bytesets import BASE, BYTE_CODE, Prefix, mix, pieces, text_buffer, tidy, window_min
from millrace.llm.components import components
from millrace.llm.frames import cut, tidy_shuffles, up_to_bound
from millrace.llm.packed import met_parts
from millrace.llm.suffixes import NO_ID, named, numbered

REACH = 8
LEAST_RUN = 20
RECALL = 0.9995
SKETCH = 33  # minima a paragraph: enough for bands of three at this recall
BROADCAST_ROWS = 2_000_000
LARGE = 64  # sets of a group that are compared each with each
PIECE_BYTES = 1 << 17  # of text at a time: its arrays fit a core's cache


def bands(least: float, recall: float, size: int = SKETCH) -> int:
    """Rows per band: the most for which a pair at the threshold still collides with probability ``recall``."""
    fitting = [r for r in range(1, size + 1) if 1 - (1 - least**r) ** (size // r) >= recall]
    return max(fitting, default=1)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and code of every word of the texts end to end."""
    inside = S._IS_WORD[raw]
    before = np.r_[False, inside[:-1]]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    return start, np.searchsorted(offsets, start, "right") - 1, Prefix(BYTE_CODE[S._FOLD][raw]).ranges(start, end)


def cuts(codes: np.ndarray, line: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Words that start a stretch inside their line: at least ``reach`` words stand on either side, and the two-word
    code is below all of those before it and not above those behind."""
    if not len(codes):
        return np.zeros(0, np.int64)
    last = np.r_[line[1:] != line[:-1], True]
    pairs = mix(codes * np.uint64(BASE) + np.where(last, np.uint64(0), np.r_[codes[1:], codes[:1]]))
    # Words of other lines are out of reach: between lines stand codes of 0, next to which nothing is smallest.
    at = np.arange(len(codes)) + reach * (np.cumsum(np.r_[False, line[1:] != line[:-1]]) + 1)
    spread = np.zeros(at[-1] + reach + 1, np.uint64)
    spread[at] = pairs
    low = window_min(spread, reach)
    return np.flatnonzero((pairs < low[at - reach]) & (pairs <= low[at + 1]))


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the paragraphs of all texts end to end, the text of each, its place there and its words."""
    edges, owner, place, word, _ = _cut_up(raw, offsets)
    return edges, owner, place, np.diff(np.searchsorted(word, edges))


def _cut_up(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the paragraphs, the text of each, its place there; start and code of every word."""
    word, text, codes = _words(raw, offsets)
    breaks = np.flatnonzero(raw == 10) + 1
    lines = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(raw)]).astype(np.int64)
    starts = np.union1d(lines, word[cuts(codes, np.searchsorted(lines, word, "right"))]).astype(np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(owner, np.arange(len(offsets) - 1))[owner]
    return np.r_[starts, len(raw)], owner, place, word, codes


def features(docs: DataFrame, rows_per_band: int) -> DataFrame:
    """Per paragraph of five words or more: where it is, the codes of its set, and its band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for i, j in pieces(offsets, PIECE_BYTES):
                at = offsets[i : j + 1] - offsets[i]
                edges, text, place, word, codes = _cut_up(raw[offsets[i] : offsets[j]], at)
                grams, where = S.gram_sets(codes, np.searchsorted(edges, word, "right") - 1, len(text), short=False)
                full = np.flatnonzero(np.diff(where))
                if not len(full):
                    continue
                one, two = S.set_codes(grams, where)
                sk = S.sketches(grams, where, SKETCH)[full]
                count = sk.shape[1] // rows_per_band
                values = np.zeros((len(full), count), np.uint64)
                for k in range(count * rows_per_band):
                    band = k // rows_per_band
                    values[:, band] = mix(values[:, band] * np.uint64(0x9E3779B97F4A7C15) + sk[:, k] + np.uint64(band + 1))
                who = pa.array(text[full])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(who), part.column(1).take(who), pa.array(place[full].astype(np.int32)),
                     S.int64(one[full]), S.int64(two[full]), *(S.int64(values[:, k]) for k in range(count))],
                    ["doc_id", "row", "line", "one", "two", *names],
                )

    names = _bands(rows_per_band)
    schema = ["doc_id long", "row long", "line int", "one long", "two long", *(f"{name} long" for name in names)]
    return docs.mapInArrow(tidy(run), ", ".join(schema))


def _bands(rows_per_band: int) -> list[str]:
    return [f"band{k}" for k in range(SKETCH // rows_per_band)]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of a sorted key that another row has too."""
    same = key[1:] == key[:-1]
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(key) else np.zeros(0, np.int64)


def _classes(feats: DataFrame) -> DataFrame:
    """Written table (one, two, copies, first): the paragraphs of each shingle set, counted, and the first of them."""

    def tally(columns: list[np.ndarray]) -> list[np.ndarray]:
        one, two, doc_id, row, line, copies = columns
        rest = _repeated(one)
        if not len(rest):
            return columns
        rest = rest[np.lexsort((line[rest], row[rest], doc_id[rest], two[rest], one[rest]))]
        fresh = np.r_[True, (one[rest[1:]] != one[rest[:-1]]) | (two[rest[1:]] != two[rest[:-1]])]
        copies = copies.copy()
        copies[rest[fresh]] = np.add.reduceat(copies[rest], np.flatnonzero(fresh))
        keep = np.ones(len(one), bool)
        keep[rest[~fresh]] = False
        return [c[keep] for c in (one, two, doc_id, row, line, copies)]

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
        names = ["one", "two", "doc_id", "row", "line", "copies"]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n == "line" else c) for n, c in zip(names, columns)], names)

    rows = feats.select("one", "two", "doc_id", "row", F.col("line").cast("long"), F.lit(1).cast("long").alias("copies"))
    found = met_parts(rows, tally, settle, "one long, two long, doc_id long, row long, line int, copies long")
    return cut(found.select("one", "two", "copies", F.struct("doc_id", "row", "line").alias("first")), "classes")


def _met(feats: DataFrame, band: str) -> DataFrame:
    """Written table (a, b): classes with the same value in a band, each next to the smallest that has it."""

    def once(columns: list[np.ndarray]) -> list[np.ndarray]:
        value, one = columns
        rest = _repeated(value)
        if not len(rest):
            return columns
        rest = rest[np.lexsort((one[rest], value[rest]))]
        again = (value[rest[1:]] == value[rest[:-1]]) & (one[rest[1:]] == one[rest[:-1]])
        keep = np.ones(len(value), bool)
        keep[rest[1:][again]] = False
        return [value[keep], one[keep]]

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
        rest = _repeated(columns[0])
        value, one = (c[rest] for c in columns)
        run = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
        low = np.minimum.reduceat(one, np.searchsorted(run, np.arange(run[-1] + 1)))[run] if len(run) else one
        other = low != one
        return pa.RecordBatch.from_arrays([pa.array(low[other]), pa.array(one[other])], ["a", "b"])

    return cut(met_parts(feats.select(band, "one"), once, settle, "a long, b long"), "shared")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, codes) of the wanted classes, from one paragraph of each."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line").alias("want"))
    lists = cut(lists, "want")
    on = (docs["doc_id"] == lists["_id"]) & (docs["row"] == lists["_row"])
    texts = docs.join(up_to_bound(lists, BROADCAST_ROWS), on).select("want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets, PIECE_BYTES):
                part = raw[offsets[i] : offsets[j]]
                edges, text, _, _ = paragraphs(part, offsets[i : j + 1] - offsets[i])
                want = b.column(0).slice(i, j - i)
                at = np.searchsorted(text, np.repeat(np.arange(j - i), np.diff(want.offsets.to_numpy())))
                at = np.sort(at + want.flatten().to_numpy())
                bounds = np.r_[0, np.cumsum(edges[at + 1] - edges[at])]
                inside = np.repeat(edges[at] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])
                grams, where = S.shingle_codes(part[inside], bounds, short=False)
                yield pa.RecordBatch.from_arrays([S.int64(S.set_codes(grams, where)[0]), S.binary(grams, where)], ["id", "codes"])

    return texts.mapInArrow(tidy(run), "id long, codes binary").dropDuplicates(["id"])


def _places(sets: DataFrame, least: float) -> DataFrame:
    """Written table (bucket, id): where to compare the sets of a group, so that all its pairs at the threshold meet.

    A group of up to ``LARGE`` sets is one bucket. In a larger one the shingles are ordered by how many sets hold them,
    the rarest first. Two sets of similarity ``least`` share one of their first n - least * n + 1 (prefix filter, exact),
    so a bucket holds the sets with one such shingle: few, even where all sets of a group share a phrase.
    """
    counts = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = up_to_bound(cut(counts.filter(F.col("n") > LARGE).select("root"), "large"), BROADCAST_ROWS)
    whole = sets.join(large, "root", "left_anti").select(F.col("root").alias("bucket"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = text_buffer(b.column(2))
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets) // 8)
            size = pa.array((np.diff(offsets) // 8).astype(np.int32)[owner])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), size,
                 pa.array(np.frombuffer(codes.tobytes(), np.int64))],
                ["root", "id", "size", "code"],
            )

    held = sets.join(large, "root", "left_semi").select("root", "id", "codes")
    held = cut(held.mapInArrow(tidy(run), "root long, id long, size int, code long"), "held")
    # A shingle of one set counts as rare and leads nowhere.
    shared = held.groupBy("root", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = up_to_bound(cut(shared, "common"), BROADCAST_ROWS)
    ranked = held.join(shared, ["root", "code"]).groupBy("root", "id", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "code"))).alias("ranked")
    )
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1 - (F.col("size") - F.size("ranked"))
    ranked = ranked.withColumn("first", F.greatest(first, F.lit(0)).cast("int"))
    placed = ranked.select("root", "id", F.explode(F.slice("ranked", 1, F.col("first"))).alias("at"))
    placed = cut(placed.select(F.xxhash64("root", "at.code").alias("bucket"), "id"), "placed")
    several = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return cut(whole.unionAll(placed.join(several, "bucket").select("bucket", "id")), "places")


def near_copies(docs: DataFrame, *, least: float = S.SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Written table (doc_id, row, line, keeper): copies by their place, and the document that keeps their like."""
    wide = bands(least, recall)
    feats = cut(features(docs, wide), "paragraphs")
    place = F.struct("doc_id", "row", "line")
    classes = _classes(feats)
    # Band after band, so that the disk holds the rows of one band's shuffle at a time.
    links = reduce(DataFrame.unionAll, [_met(feats, band) for band in _bands(wide)])
    groups = components(links)
    wanted = groups.join(classes, groups["id"] == classes["one"]).select(
        "one", "root", "first.doc_id", "first.row", "first.line"
    )
    wanted = cut(wanted, "wanted")
    sets = cut(_sets(docs, wanted).join(wanted.select(F.col("one").alias("id"), "root"), "id"), "sets")
    blocks = S.in_blocks(_places(sets, least), "bucket").join(sets.select("id", "codes"), "id")
    roots = components(cut(S.near_links(blocks, "bucket", least), "exact"))
    rooted = classes.join(roots.withColumnRenamed("id", "_rid"), F.col("one") == F.col("_rid"), "left").select(
        "one", "two", "copies", "first", F.coalesce("root", "one").alias("root"), F.col("root").isNotNull().alias("tied")
    ).filter("tied or copies > 1")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    named = cut(rooted.join(firsts, "root").select("one", "two", "keep"), "named")
    found = feats.join(named, ["one", "two"]).filter(~F.col("keep").eqNullSafe(place))
    return cut(found.select("doc_id", "row", "line", F.col("keep.doc_id").alias("keeper")), "removed")


def runs(places: np.ndarray, words: np.ndarray, least: int = LEAST_RUN) -> np.ndarray:
    """Which of the copies (sorted places) stand in a run of at least ``least`` words; ``words`` is of all paragraphs."""
    return _in_runs(places, words[places], least)


def _in_runs(places: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    number = np.cumsum(np.diff(places, prepend=places[:1]) > 1)
    return np.bincount(number, words)[number] >= least


def _by_text(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values (sorted by their text) as one list for each of ``n`` texts."""
    return pa.ListArray.from_arrays(np.searchsorted(text, np.arange(n + 1)).astype(np.int32), np.ascontiguousarray(values))


def _without(docs: DataFrame, least: int) -> DataFrame:
    """Each whole text without its removed paragraphs; ``docs`` has (doc_id, text, copies) with copies (line, keeper)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets, PIECE_BYTES):
                at, piece = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
                edges, text, _, words = paragraphs(piece, at)
                first = np.searchsorted(text, np.arange(j - i + 1))
                lists = b.column(2).slice(i, j - i)
                held = lists.flatten()
                line, keeper = (pc.struct_field(held, name).to_numpy() for name in ("line", "keeper"))
                doc = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                order = np.lexsort((keeper, line, doc))
                line, keeper, doc = line[order], keeper[order], doc[order]
                place = first[doc] + line
                gone = _in_runs(place + doc, words[place], least)  # a step of two or more from one text to the next
                line, keeper, doc = line[gone], keeper[gone], doc[gone]
                whole = np.ones(len(text), bool)
                whole[place[gone]] = False
                keep = np.repeat(whole, np.diff(edges))
                told = keeper != NO_ID
                pairs = np.unique(np.stack([doc[told], keeper[told]], 1), axis=0)
                ends = np.r_[0, np.cumsum(keep)][at]
                kept = pa.Array.from_buffers(
                    pa.large_string(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(piece[keep].tobytes())]
                ).cast(pa.string())
                known = b.column(1).slice(i, j - i).is_valid().to_numpy(zero_copy_only=False)
                count = np.where(np.diff(at) > 0, np.diff(first), known)  # an empty text is one paragraph
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(count.astype(np.int64)), pa.array(np.bincount(doc, minlength=j - i)),
                     _by_text(doc, line.astype(np.int32), j - i), _by_text(pairs[:, 0], pairs[:, 1], j - i), kept],
                    ["doc_id", "n_paragraphs", "n_removed", "removed", "keepers", "kept"],
                )

    return docs.mapInArrow(
        tidy(run), "doc_id long, n_paragraphs long, n_removed long, removed array<int>, keepers array<long>, kept string"
    )


def remove_near_copies(
    documents: DataFrame, *, least: float = S.SIMILARITY, recall: float = RECALL, least_run: int = LEAST_RUN
) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_removed, removed (places), keepers (documents), kept (text)."""
    with tidy_shuffles(documents.sparkSession):
        docs = numbered(documents)
        gone = near_copies(docs, least=least, recall=recall)
        lists = gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
            F.collect_list(F.struct("line", "keeper")).alias("copies")
        )
        joined = docs.join(lists, (docs["doc_id"] == lists["_id"]) & (docs["row"] == lists["_row"]), "left")
        return _without(joined.select("doc_id", "text", "copies"), least_run).withColumn("doc_id", named("doc_id"))
