"""Reachability and path-length relaxations over edge tables.

Every round joins only the newest frontier to the edges and removes what is already known, so a
cycle ends and a diamond is visited once. Rounds are bounded by the longest path, not by the node
count; each is one write, and the number of driver steps does not depend on the data size. Edges laid out by the column
that is walked from (``durable.cut_by``) stay where they are in all rounds; others are moved in each round whose frontier
is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.durable import cut, cut_by


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in pairs])


def closure(
    edges: DataFrame,
    start: DataFrame,
    *,
    frm: Sequence[str] = ("src",),
    to: Sequence[str] = ("dst",),
    carry: Sequence[str] = (),
    stop: DataFrame | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """Nodes reachable from ``start`` (included, ``hop`` 0), walking ``frm`` → ``to``.

    ``start`` holds the node key columns named like ``to`` plus any ``carry`` columns, which keep
    separate walks apart. Nodes listed in ``stop`` are reported but not expanded. With ``within`` only nodes listed there
    are entered; the newly found nodes of a round are looked up in it, not the edges.
    """
    key = [*to, *carry]
    steps = edges.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(frm)], *to)
    walked = [cut(start.select(*key).distinct().withColumn("hop", F.lit(0)), "reach")]
    frontier = walked[0]
    while True:  # ends when nothing new is found, at the latest with the last node
        if stop is not None:
            blocked = stop.select(*[F.col(c).alias(f"_s_{c}") for c in to])
            frontier = frontier.join(
                blocked, _same(frontier, blocked, [(c, f"_s_{c}") for c in to]), "left_anti"
            )
        here = frontier.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(to)], *carry)
        found = (
            here.join(steps, _same(here, steps, [(f"_h{i}", f"_f{i}") for i in range(len(to))]))
            .select(*key)
            .distinct()
        )
        known = reduce(DataFrame.unionAll, [w.select(*key) for w in walked])
        fresh = cut(found.join(known, list(key), "left_anti").withColumn("hop", F.lit(len(walked))), "reach")
        if within is not None:
            entered = fresh.select(*to).distinct()
            real = cut(within.select(*to).join(entered, list(to), "left_semi").distinct(), "reach")
            fresh = cut(fresh.join(real, list(to), "left_semi").select(*key, "hop"), "reach")
        if fresh.isEmpty():
            return reduce(DataFrame.unionAll, walked)
        walked.append(fresh)
        frontier = fresh


def longest_path(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Depth of every node = length of the longest path that ends in it, inside ``nodes``.

    Nodes are peeled: one leaves in the round after the last of its inputs left, which is its depth, so each node and
    edge is used once and only the frontier and the nodes with some inputs left are written. Nodes on a cycle, or fed
    by one, never lose all their inputs and get depth 0. What an edge brings to a node that is not listed is dropped with
    the inputs, so edges are filtered by their start only.
    """
    every = cut_by(nodes.select("id"), ["id"], "nodes", distinct=True)
    steps = edges.select("src", "dst")
    inner = steps.join(every.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    counted = inner.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_need"))
    inputs = cut_by(counted.join(every, "id", "left_semi"), ["id"], "inputs")
    left = [cut(every.join(inputs, "id", "left_anti").withColumn("depth", F.lit(0)), "depth")]
    waiting = None
    for depth in count(1):
        out = left[-1].join(steps, left[-1]["id"] == steps["src"]).select("src", "dst").distinct()
        came = out.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_got"))
        if waiting is not None:
            came = came.unionAll(waiting).groupBy("id").agg(F.sum("_got").alias("_got"))
        met = cut(came.join(inputs, "id"), "met")
        ready = met.filter("_got = _need").select("id", F.lit(depth).alias("depth"))
        if ready.isEmpty():
            break
        left.append(cut(ready, "depth"))
        waiting = met.filter("_got < _need").select("id", "_got")
    found = reduce(DataFrame.unionAll, left)
    return every.join(found, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def spread(
    edges: DataFrame, labels: DataFrame, *, label: str = "label", keep: str = "min",
) -> DataFrame:
    """(id, label, came): the smallest (or largest) label that reaches each node along ``src`` → ``dst``.

    ``labels(id, label)`` seeds the walk. Labels are merged per node before they travel on, so the
    cost follows the edges and never the number of (label, node) pairs. ``came`` is the best label that an edge brings,
    the node's own seed left aside; null where none does.
    """
    fold, pick = (F.min, F.least) if keep == "min" else (F.max, F.greatest)
    better = (lambda new, old: new < old) if keep == "min" else (lambda new, old: new > old)
    steps = edges.select("src", "dst")
    seeded = labels.groupBy("id").agg(fold(label).alias(label))
    best = cut(seeded.withColumn("came", F.lit(None).cast(seeded.schema[label].dataType)), "label")
    frontier = best.select("id", label)
    while True:
        pushed = (
            frontier.join(steps, frontier["id"] == steps["src"])
            .groupBy(F.col("dst").alias("id"))
            .agg(fold(label).alias("_new"))
        )
        merged = cut(
            best.join(pushed, "id", "full").select(
                "id",
                pick(label, "_new").alias(label),
                pick("came", "_new").alias("came"),
                F.coalesce(better(F.col("_new"), F.col(label)), F.col(label).isNull()).alias("_better"),
            ),
            "label",
        )
        frontier = merged.filter("_better").select("id", label)
        best = merged.select("id", label, "came")
        if frontier.isEmpty():
            return best


def on_cycles(pointers: DataFrame, *, node: str = "id", nxt: str = "next") -> DataFrame:
    """(node, cycle): nodes of a one-successor graph whose chain returns to them, and the smallest node of their cycle.

    After k rounds a pointer has moved 2^k steps. What nobody points at by then stands outside every cycle and is
    trimmed, and so is a chain that ended, so a round joins only cycles and what hangs far above them. Once all
    remaining nodes are pointed at, they are the cycles: rounds follow the logarithm of the longest way into a cycle.
    The smallest node is then handed on along the cycles in the same way.
    """
    hops = cut(
        pointers.filter(F.col(nxt).isNotNull()).select(F.col(node).alias("id"), F.col(nxt).alias("step"), F.col(nxt).alias("at")), "hops"
    )
    size = hops.count()
    while size:
        over = hops.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
        aimed = hops.select(F.col("at").alias("_aim")).distinct()
        kept = hops.join(aimed, F.col("id") == F.col("_aim"), "left_semi")
        moved = kept.join(over, F.col("at") == F.col("_id")).select("id", "step", F.col("_at").alias("at"))
        hops = cut(moved, "hops")
        before, size = size, hops.count()
        if size == before:
            break
    least = cut(hops.select("id", F.col("step").alias("at"), F.col("id").alias("least")), "least")
    while True:
        over = least.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        met = least.join(over, F.col("at") == F.col("_id"))
        if met.filter("least <> _least").isEmpty():
            return least.select(F.col("id").alias(node), F.col("least").alias("cycle"))
        least = cut(met.select("id", F.col("_at").alias("at"), F.least("least", "_least").alias("least")), "least")
