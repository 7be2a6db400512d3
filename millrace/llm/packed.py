"""Fixed-width rows dealt to tasks by a uniform 64-bit key, packed: a row of Spark holds thousands of them.

Grouping hundreds of millions of short rows costs mostly what each row costs. Here a task sorts its rows in runs of
``RUN``, folds what it can, and hands on one cell per column and part; a part then meets whole in one task. Parts are
ranges of the key, so rows of one key are in one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.bytesets import tidy
from millrace.llm.shingles import binary, groups

RUN = 1 << 19
PER_PARTITION = 2  # parts a shuffle partition: more come out more even, in smaller cells

Columns = list[np.ndarray]
_BITS = 24


def met_parts(
    rows: DataFrame, fold: Callable[[Columns], Columns], settle: Callable[[Columns], pa.RecordBatch], schema: str
) -> DataFrame:
    """``settle`` of each part of ``rows``, whose columns are longs and the first of them the key.

    ``fold`` takes rows sorted by the key, some or all of a part, and returns such rows; it may be given its own again.
    """
    parts = min(PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << _BITS)

    def ordered(columns: Columns) -> Columns:
        order = np.argsort(columns[0].view(np.uint64))
        return fold([c[order] for c in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(c[0]) for c in held) >= RUN:
                yield packed(held)
                held = []
        if sum(len(c[0]) for c in held):
            yield packed(held)

    def packed(held: list[Columns]) -> pa.RecordBatch:
        columns = ordered([np.concatenate(c) for c in zip(*held)])
        part = (columns[0].view(np.uint64) >> np.uint64(64 - _BITS)) * np.uint64(parts) >> np.uint64(_BITS)
        edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[edges[:-1]].astype(np.int32)), *(binary(c, edges) for c in columns)],
            ["part", *(f"c{k}" for k in range(len(columns)))],
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            yield settle(ordered([np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in table.columns[1:]]))

    cells = rows.mapInArrow(tidy(pack), ", ".join(["part int", *(f"c{k} binary" for k in range(len(rows.columns)))]))
    return cells.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(meet), schema)
