"""Sets of five-word shingles as 64-bit codes, their sketches, and exact links inside groups of similar sets.

Words are runs of digits, ASCII letters (case folded) and non-ASCII characters; a text of one to four words is a
single shingle; a text without words has an empty set and links with nothing.

Links are decided on the sets themselves. ``linked_blocks`` gets groups of sets that a sketch found similar and
compares every pair of a group exactly, in blocks, so a group of any size is split over tasks and no pair is ever
a row: what comes out is a link count per set and a few links per block that keep its components together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import BASE, BYTE_CODE, Prefix, mix, pieces, text_buffer, tidy

WORDS = 5
SIMILARITY = 0.8
SKETCH = 64
BLOCK = 256
TOGETHER = 64  # sets of a block that is compared along with others
SKETCH_BLOCK = 2_048  # sketches are small, so more of them meet in one task

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_WORD[65:91] = True
_FOLDED_CODE = BYTE_CODE[_FOLD]
_RNG = np.random.default_rng(77)
_ODD = _RNG.integers(1, 2**62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**62, SKETCH, dtype=np.uint64)


def shingle_codes(
    raw: np.ndarray, offsets: np.ndarray, words: int = WORDS, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each text, sorted, end to end; and the n + 1 offsets of the texts.

    Without ``short``, a text of fewer than ``words`` words has no shingle.
    """
    n = len(offsets) - 1
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = _IS_WORD[raw]
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    codes = Prefix(_FOLDED_CODE[raw]).ranges(start, end)
    return gram_sets(codes, np.searchsorted(offsets, start, "right") - 1, n, words, short)


def gram_sets(
    codes: np.ndarray, doc: np.ndarray, n: int, words: int = WORDS, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_codes`` of ``n`` texts, given the code and the text of every word."""
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    count = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    m = len(codes) - words + 1
    if m > 0:
        grams = np.zeros(m, np.uint64)
        for k in range(words):
            grams = grams * np.uint64(BASE) + codes[k : k + m]
        whole = doc[:m] == doc[words - 1 :]
        grams, owner = mix(grams[whole]), doc[:m][whole]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < words))
    if short and len(few):
        extra = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            at = np.minimum(first[few] + k, len(codes) - 1)
            extra = np.where(has, extra * np.uint64(BASE) + codes[at], extra)
        grams = np.r_[grams, mix(extra + count[few].astype(np.uint64))]
        owner = np.r_[owner, few]
    if not len(grams):
        return grams, np.zeros(n + 1, np.int64)
    # One key of text and leading bits sorts much faster than two; where it cannot tell two shingles apart, both decide.
    high = n.bit_length()
    order = np.argsort(owner.astype(np.uint64) << np.uint64(64 - high) | grams >> np.uint64(high))
    if ((grams[order[1:]] < grams[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])).any():
        order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]


def set_codes(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each whole set; equal sets have equal codes."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        each = mix(grams ^ np.uint64(salt))
        sums = np.r_[np.uint64(0), np.cumsum(each, dtype=np.uint64)]
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(np.uint64))
    return out[0], out[1]


def sketches(grams: np.ndarray, offsets: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Min-wise sketch of each set: ``size`` 32-bit minima (all ones for an empty set)."""
    n = len(offsets) - 1
    out = np.full((n, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k in range(size):
            h = (grams * _ODD[k] + _ADD[k]) >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(h.astype(np.uint32), starts)
    return out


def per_text(df: DataFrame, text_at: int, schema: str, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list]) -> DataFrame:
    """Map rows in pieces of bounded bytes; ``fn`` gets the rows, their shingle codes and offsets."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(text_at))
            for i, j in pieces(offsets):
                at = offsets[i : j + 1]
                grams, where = shingle_codes(raw[at[0] : at[-1]], at - at[0])
                columns = fn(b.slice(i, j - i), grams, where)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(tidy(run), schema)


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of ``values`` as one binary cell each."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())],
    ).cast(pa.binary())


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading ``keys`` columns in sorted batches; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        turn = np.zeros(b.num_rows, bool)
        turn[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn[1:]) + 1, b.num_rows] if not turn[0] else [0, 0, *np.flatnonzero(turn[1:]) + 1, b.num_rows]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if i:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if e > s:
                held.append(b.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def local_roots(near: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row of a symmetric adjacency matrix."""
    n = len(near)
    root = np.arange(n, dtype=np.int32)
    while True:
        best = np.concatenate([np.where(near[k : k + 512], root, np.int32(n)).min(1) for k in range(0, n, 512)])
        best = np.minimum(root, best)
        best = best[best]
        if (best == root).all():
            return root
        root = best


def similar_links(buckets: DataFrame, least: float) -> DataFrame:
    """(a, b) links between sets of one bucket whose sketches agree in at least ``least`` of their places.

    ``buckets`` has (bucket, i, j, side, id, sketch): block i against block j of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b, size = [], [], 0
        for table in groups(batches, 3):
            n = table.num_rows
            if n < 2:
                continue
            ids = table.column("id").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(n, -1)
            if n <= 32:
                near = (sk[:, None, :] == sk[None, :, :]).sum(2)
            else:
                near = np.zeros((n, n), np.uint8)
                for k in range(sk.shape[1]):
                    near += sk[:, k][:, None] == sk[:, k][None, :]
            root = local_roots(near >= least * sk.shape[1])
            tied = np.flatnonzero(root != np.arange(n))
            found_a.append(ids[root[tied]])
            found_b.append(ids[tied])
            size += len(tied)
            if size > 100_000:
                yield _links(found_a, found_b)
                found_a, found_b, size = [], [], 0
        if size:
            yield _links(found_a, found_b)

    return _by_block(buckets, ["bucket", "i", "j"], ["id", "sketch"]).mapInArrow(tidy(run), "a long, b long").distinct()


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct links; alike sets share many buckets."""
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _by_block(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, rest[0])


def in_blocks(members: DataFrame, group: str, size: int = BLOCK) -> DataFrame:
    """Rows of each group dealt to blocks of about ``size``, once for each pair of blocks they are in.

    ``members`` has ``group``, ``id`` and other columns. A group within ``size`` is one block.
    """
    counts = members.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    dealt = members.join(counts.filter("_blocks > 1"), members[group] == F.col("_g"), "left").drop("_g")
    blocks = F.coalesce("_blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    return dealt.withColumn("_mine", mine).withColumn("_p", F.explode(others)).select(
        *members.columns, F.col("_mine").alias("side"), F.col("_p.i").alias("i"), F.col("_p.j").alias("j")
    )


def linked_blocks(blocks: DataFrame, group: str, least: float = SIMILARITY) -> DataFrame:
    """(id, other, links): exact Jaccard links of every block pair.

    ``blocks`` has (group, i, j, side, id, copies, codes). A row with ``other`` null counts the copies linked to
    ``id``; a row with ``other`` is a link that keeps components together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            n = table.num_rows
            if n < 2:
                continue
            i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            ids = table.column("id").to_numpy()
            side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            near = exact_near(table.column("codes").to_pylist(), least)
            if i != j:  # pairs inside one block are counted where that block meets itself
                near &= side[:, None] != side[None, :]
            else:
                np.fill_diagonal(near, False)
            linked = near @ copies
            some = np.flatnonzero(linked)
            root = local_roots(near)
            tied = np.flatnonzero(root != np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[some], ids[tied]]),
                 pa.array(np.r_[np.zeros(len(some), np.int64), ids[root[tied]]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(tied), bool)]),
                 pa.array(np.r_[linked[some], np.zeros(len(tied), np.int64)].astype(np.int64))],
                ["id", "other", "links"],
            )

    rows = _by_block(blocks, [group, "i", "j"], ["id", "side", "copies", "codes"])
    return rows.mapInArrow(tidy(run), "id long, other long, links long")


def near_links(blocks: DataFrame, group: str, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links that keep together what exact Jaccard similarity ties in a block pair.

    ``blocks`` has (group, i, j, side, id, codes). Small blocks, of which there are many, are compared together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            last = _block_edges(held)[-2]
            if last:
                yield from tied(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from tied(held)

    def tied(table: pa.Table) -> Iterator[pa.RecordBatch]:
        edges = _block_edges(table)
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        across = table.column("i").to_numpy() != table.column("j").to_numpy()
        cells = table.column("codes")
        count = np.diff(edges)
        small = count <= TOGETHER
        a, b = _pairs(edges[:-1][small], count[small])
        meet = ~across[a] | (side[a] != side[b])  # pairs inside one block meet where that block meets itself
        found = [near_pairs(cells, a[meet], b[meet], least)]
        for s, e in zip(edges[:-1][~small], edges[1:][~small]):
            near = exact_near(cells.slice(s, e - s).to_pylist(), least)
            if across[s]:
                near &= side[s:e, None] != side[None, s:e]
            root = local_roots(near)
            other = np.flatnonzero(root != np.arange(e - s))
            found.append((s + root[other], s + other))
        a, b = (np.concatenate(x) for x in zip(*found))
        root = np.arange(len(ids))
        while True:
            best = root.copy()
            np.minimum.at(best, a, root[b])
            np.minimum.at(best, b, root[a])
            best = best[best]
            if (best == root).all():
                break
            root = best
        other = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[other]]), pa.array(ids[other])], ["a", "b"])

    return _by_block(blocks, [group, "i", "j"], ["id", "side", "codes"]).mapInArrow(tidy(run), "a long, b long")


def _block_edges(table: pa.Table) -> np.ndarray:
    """Where the runs of equal leading three columns begin, and the end."""
    turn = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in range(3):
        c = table.column(k).to_numpy()
        turn |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(turn) + 1, table.num_rows]


def _pairs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each run of ``count`` rows from ``start``."""
    row = np.repeat(start, count) + _ramp(count)
    later = np.repeat(start + count, count) - row - 1
    left = np.repeat(row, later)
    return left, left + 1 + _ramp(later)


def _ramp(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, end to end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def near_pairs(
    cells: pa.ChunkedArray, left: np.ndarray, right: np.ndarray, least: float, most: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of sets (sorted codes) that have Jaccard similarity of at least ``least``."""
    raw, offsets = text_buffer(cells)
    offsets = offsets // 8
    sizes = np.diff(offsets)
    fit = np.minimum(sizes[left], sizes[right]) >= least * np.maximum(sizes[left], sizes[right]) - 1e-6
    left, right = left[fit], right[fit]
    if not len(left):
        return left, right
    rank = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)[1]
    both = sizes[left] + sizes[right]
    common = np.zeros(len(left), np.int64)
    turns = np.flatnonzero(np.diff((np.cumsum(both) - both) // most, prepend=-1))
    for s, e in zip(turns, np.r_[turns[1:], len(left)]):  # a bounded number of shingles at a time
        sets = np.stack([left[s:e], right[s:e]], 1).ravel()
        pair = np.repeat(np.arange(e - s), both[s:e])
        codes = rank[np.repeat(offsets[sets], sizes[sets]) + _ramp(sizes[sets])]
        keys = np.sort(pair * (len(rank) + 1) + codes)
        twice = keys[1:][keys[1:] == keys[:-1]]
        common[s:e] = np.bincount(twice // (len(rank) + 1), minlength=e - s)
    near = (common >= least * (both - common) - 1e-6) & (common > 0)
    return left[near], right[near]


def exact_near(cells: list[bytes], least: float) -> np.ndarray:
    """Which pairs of sets (sorted codes) have Jaccard similarity of at least ``least``."""
    n = len(cells)
    sizes = np.array([len(c) // 8 for c in cells])
    codes = np.frombuffer(b"".join(cells), np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    uniq, at, seen = np.unique(codes, return_inverse=True, return_counts=True)
    shared = seen[at] > 1
    places = np.cumsum(seen > 1) - 1
    owner, at = owner[shared], places[at[shared]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):  # a few thousand shingles at a time
        s, e = np.searchsorted(at, (lo, lo + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[owner[s:e], at[s:e] - lo] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return (common >= least * union - 1e-6) & (common > 0)
