"""Removal of repeated byte strings by range-partitioned suffixes.

A byte goes if some ``SPAN``-byte string over it also starts earlier (smaller doc_id, or the same document and an
earlier start). The suffixes that decide this are found without sorting one suffix per byte:

1. Every ``SPAN`` bytes in a row choose an anchor, the ``GRAM`` bytes with the smallest hash among them, so equal strings
   choose equal anchors at equal offsets. An anchor with the run of string starts that chose it, and the bytes from the
   first of these to the end of the last string, is one row: a few per cent of the bytes.
2. Rows are range-partitioned by their leading gram (its code), then the code of their bytes, document and start; the
   splitters are sampled by ``repartitionByRange``, and the tie-breaks let any hot gram spread over partitions. In a
   sorted bucket a gram met once is new; of rows with equal bytes all but the first repeat it whole; what is left are
   rows that share a gram but differ somewhere. Groups cut by a bucket's boundary are left open and compared across
   it in the next step.
3. The suffixes at every start of those rows, cut at ``SPAN`` bytes, are sorted by multikey quicksort (eight bytes are one
   character of a key) and neighbours are compared; of equal ones all but the first repeat it. Groups larger than
   ``GROUP``, or open at a boundary, are compared by 128-bit codes of the strings over the whole cluster instead, with the
   smallest start kept per code by a partial aggregate, so no group is one task's work.

Documents and repeats are then joined and each whole text is cut. Rows are told apart by ``row``, the place in
doc_id order among rows of an equal id.

Defined cases: null text is empty; rows with a null doc_id come before all others (the smallest long is read as null); rows with an equal doc_id are ordered
by a code of their text, equal rows by chance (either keeps the string, the other loses it); texts shorter than
``SPAN`` bytes lose nothing; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import BYTE_CODE, Prefix, gram_hashes, mix, pieces, text_buffer, tidy, window_min
from millrace.llm.frames import cut, tidy_shuffles
from millrace.llm.shingles import groups, int64

SPAN = 100
GRAM = 32
GROUP = 1_000
NO_ID = -(2**63)  # stands for a null doc_id inside the operators: it sorts first, as a null does
_LOW = np.uint64(0xFFFFFF)
_OTHER_CODE = mix(BYTE_CODE ^ np.uint64(0xA54FF53A5F1D36F1)) | np.uint64(1)


def anchors(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, code): the string starts first..last of a text chose this anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < span:
        return none, none, none, none, none.view(np.uint64)
    codes = mix(gram_hashes(raw, gram))
    # The place in the low bits makes the leftmost of equal codes win; it repeats only every 2^24 bytes.
    keyed = (codes & ~_LOW) | (np.arange(len(codes), dtype=np.uint64) & _LOW)
    chosen = (window_min(keyed, span - gram + 1) & _LOW).astype(np.int64)
    start = np.arange(len(chosen))
    anchor = start + ((chosen - start) & int(_LOW))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + span <= offsets[1:][text]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return none, none, none, none, none.view(np.uint64)
    turn = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = start[np.r_[turn[1:] - 1, len(start) - 1]]
    return text[turn], anchor[turn], start[turn], last, codes[anchor[turn]]


def _rows(documents: DataFrame) -> DataFrame:
    """Candidate rows of every document: gram code, code of the bytes, document, start and number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            row = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                text, anchor, first, last, code = anchors(part, at)
                if not len(text):
                    continue
                body = Prefix(BYTE_CODE[part]).ranges(first, last + SPAN) ^ mix((anchor - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [int64(code), int64(body), pa.array(ids[i:j][text]), pa.array(row[i:j][text]),
                     pa.array(first - at[text]), pa.array((last - first + 1).astype(np.int32))],
                    ["gram", "body", "doc_id", "row", "start", "n"],
                )

    return documents.mapInArrow(tidy(run), "gram long, body long, doc_id long, row long, start long, n int")


def _judge(rows: DataFrame) -> DataFrame:
    """(doc_id, row, start, n, gram, kind) of rows that are not new: kind 0 repeats whole, 1 compare in its group,
    2 compare over the cluster. Stateless per sorted batch: its first and last group are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gram, body = b.column(0).to_numpy(), b.column(1).to_numpy()
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new_body = new_gram | np.r_[True, body[1:] != body[:-1]]
            group = np.cumsum(new_gram) - 1
            bodies = np.bincount(group, new_body)
            opened = (group == 0) | (group == group[-1])
            kind = np.where(opened | (bodies[group] > GROUP), 2, 1)
            kind[~new_body] = 0
            told = ~new_body | opened | (bodies[group] > 1)
            keep = np.flatnonzero(told)
            if len(keep):
                kept = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(2), kept.column(3), kept.column(4), kept.column(5), kept.column(0), pa.array(kind[keep].astype(np.int32))],
                    ["doc_id", "row", "start", "n", "gram", "kind"],
                )

    order = ["gram", "body", "doc_id", "row", "start"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.mapInArrow(tidy(run), "doc_id long, row long, start long, n int, gram long, kind int")


def multikey_order(heads: np.ndarray, owner: np.ndarray, texts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``texts[heads:heads + span]`` inside their owner, and which of them start a new string.

    Three-way partitioning by one eight-byte character after the other: only runs still equal are sorted further.
    """
    width = 8
    padded = np.r_[texts, np.zeros(width, np.uint8)]
    words = np.zeros(len(texts), np.uint64)
    for k in range(width):
        words = (words << np.uint64(8)) | padded[k : k + len(texts)]
    order = np.argsort(owner, kind="stable")
    run = owner[order]
    fresh = np.r_[True, run[1:] != run[:-1]]
    depth = 0
    while depth < span:
        take = min(width, span - depth)
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[starts, len(order)])
        busy = np.repeat(sizes > 1, sizes)
        if not busy.any():
            break
        at = np.flatnonzero(busy)
        segment = np.cumsum(fresh)[at]
        char = words[heads[order[at]] + depth]
        if take < width:
            char = char >> np.uint64(8 * (width - take))
        sub = np.lexsort((char, segment))
        order[at] = order[at][sub]
        char, segment = char[sub], segment[sub]
        split = np.r_[True, (char[1:] != char[:-1]) | (segment[1:] != segment[:-1])]
        fresh[at] |= split
        depth += take
    return order, fresh


def _compare_groups(bodies: DataFrame) -> DataFrame:
    """(doc_id, row, start, end): starts of strings that repeat an earlier one of their group."""

    def flush(tables: list[pa.Table]) -> pa.RecordBatch | None:
        owner, heads, ids, row, at, blobs, shift = [], [], [], [], [], [], 0
        for k, t in enumerate(tables):
            n = t.column("n").to_numpy().astype(np.int64)
            cells = t.column("body").to_pylist()
            begin = shift + np.r_[0, np.cumsum([len(c) for c in cells])]
            rep = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            owner.append(np.full(len(rep), k))
            heads.append(begin[:-1][rep] + step)
            ids.append(t.column("doc_id").to_numpy(zero_copy_only=False)[rep])
            row.append(t.column("row").to_numpy()[rep])
            at.append(t.column("start").to_numpy()[rep] + step)
            blobs.extend(cells)
            shift = int(begin[-1])
        if not owner:
            return None
        owner, heads, ids, row, at = map(np.concatenate, (owner, heads, ids, row, at))
        # Rows come in (doc_id, row, start) order, and every sort is stable: the first of equal strings is the earliest.
        order, fresh = multikey_order(heads, owner, np.frombuffer(b"".join(blobs), np.uint8), SPAN)
        late = order[~fresh]
        if not len(late):
            return None
        late.sort()
        ids, row, at = ids[late], row[late], at[late]
        turn = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
        end = at[np.r_[turn[1:] - 1, len(at) - 1]] + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[turn]), pa.array(row[turn]), pa.array(at[turn]), pa.array(end)], ["doc_id", "row", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in groups(batches, 1):
            held.append(table)
            size += table.num_rows
            if size >= 5_000:
                out = flush(held)
                if out is not None:
                    yield out
                held, size = [], 0
        out = flush(held)
        if out is not None:
            yield out

    laid = bodies.select("gram", "doc_id", "row", "start", "n", "body").repartition("gram").sortWithinPartitions(
        "gram", "doc_id", "row", "start"
    )
    return laid.mapInArrow(tidy(run), "doc_id long, row long, start long, end long")


def _compare_codes(bodies: DataFrame) -> DataFrame:
    """The same for groups that are too large for a task or were cut by a boundary, by 128-bit string codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                t = b.slice(lo, 2_000)
                raw, offsets = text_buffer(t.column(4))
                n = t.column(3).to_numpy().astype(np.int64)
                rep = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                head = offsets[:-1][rep] + step
                one = Prefix(BYTE_CODE[raw]).ranges(head, head + SPAN)
                two = Prefix(_OTHER_CODE[raw]).ranges(head, head + SPAN)
                yield pa.RecordBatch.from_arrays(
                    [int64(one), int64(two), t.column(0).take(pa.array(rep)), t.column(1).take(pa.array(rep)),
                     pa.array(t.column(2).to_numpy()[rep] + step)],
                    ["one", "two", "doc_id", "row", "start"],
                )

    strings = cut(
        bodies.select("doc_id", "row", "start", "n", "body").mapInArrow(tidy(run), "one long, two long, doc_id long, row long, start long"),
        "strings",
    )
    firsts = strings.groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "row", "start")).alias("_first")
    ).filter("_n > 1").select("one", "two", "_first")
    same = F.struct("doc_id", "row", "start").eqNullSafe(F.col("_first"))
    late = strings.join(firsts, ["one", "two"]).filter(~same)
    return late.select("doc_id", "row", "start", (F.col("start") + 1).alias("end"))


def _bodies(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the rows to compare, taken from their documents."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("start", "n", "gram", "kind")).alias("spans")
    )
    texts = documents.join(lists, (documents["doc_id"] == lists["_id"]) & (documents["row"] == lists["_row"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            spans = b.column(3)
            counts = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            owner = np.repeat(np.arange(b.num_rows), counts)
            for lo in range(0, len(start), 20_000):
                hi = min(lo + 20_000, len(start))
                begin = offsets[:-1][owner[lo:hi]] + start[lo:hi]
                cells = [raw[s:e].tobytes() for s, e in zip(begin.tolist(), (begin + n[lo:hi] + SPAN - 1).tolist())]
                who = pa.array(owner[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [flat.field(2).slice(lo, hi - lo), flat.field(3).slice(lo, hi - lo), b.column(0).take(who), b.column(1).take(who),
                     pa.array(start[lo:hi]), pa.array(n[lo:hi]), pa.array(cells, pa.binary())],
                    ["gram", "kind", "doc_id", "row", "start", "n", "body"],
                )

    return texts.select("doc_id", "row", "text", "spans").mapInArrow(
        tidy(run), "gram long, kind int, doc_id long, row long, start long, n int, body binary"
    )


def named(doc_id: str) -> Column:
    """The id a row came with."""
    return F.when(F.col(doc_id) != NO_ID, F.col(doc_id))


def numbered(documents: DataFrame) -> DataFrame:
    """(doc_id, row, text) where ``row`` orders the rows of an equal doc_id (0 where the id is unique)."""
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id")), "again")
    if again.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    # Rare rows only: place them by their text's code in a range layout.
    from millrace.plans.ordered import running

    tied = docs["doc_id"] == again["_id"]
    placed = running(
        docs.join(again, tied, "left_semi").withColumn("_code", F.xxhash64("text")), ["doc_id"], ["_code"], number="row"
    ).select("doc_id", "row", "text")
    alone = docs.join(again, tied, "left_anti").select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    return cut(alone.unionByName(placed), "numbered")


def repeats(numbered: DataFrame) -> DataFrame:
    """Written table (doc_id, row, start, end): the string starts that repeat an earlier string."""
    judged = cut(_judge(_rows(numbered)), "judged")
    bodies = cut(_bodies(numbered, judged.filter("kind > 0")), "bodies")
    local = _compare_groups(bodies.filter("kind = 1"))
    wide = _compare_codes(bodies.filter("kind = 2"))
    whole = judged.filter("kind = 0").select("doc_id", "row", "start", (F.col("start") + F.col("n")).alias("end"))
    return cut(whole.unionAll(local).unionAll(wide), "repeats")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    with tidy_shuffles(documents.sparkSession):
        rows = numbered(documents)
        found = repeats(rows)
        lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
            F.collect_list(F.struct("start", "end")).alias("spans")
        )
        joined = rows.join(
            lists, (rows["doc_id"] == lists["_id"]) & (rows["row"] == lists["_row"]), "left"
        ).select("doc_id", "text", "spans")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, offsets = text_buffer(b.column(1))
                spans = b.column(2)
                out: list[tuple] = []
                for k in range(b.num_rows):
                    body = raw[offsets[k] : offsets[k + 1]]
                    gone, runs, kept = 0, 0, body
                    if spans[k].is_valid:
                        flat = spans[k].values
                        marks = np.zeros(len(body) + 1, np.int32)
                        np.add.at(marks, flat.field(0).to_numpy(), 1)
                        np.add.at(marks, np.minimum(flat.field(1).to_numpy() + SPAN - 1, len(body)), -1)
                        inside = np.cumsum(marks[:-1]) > 0
                        gone, kept = int(inside.sum()), body[~inside]
                        runs = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
                    out.append((len(body), gone, runs, kept.tobytes()))
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

        out = joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
        return out.withColumn("doc_id", named("doc_id"))

