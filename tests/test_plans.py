"""Plan building blocks against brute force, with one key holding a third of the rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import durable, ordered, percentiles, reach
from millrace.plans.percentiles import Quantile


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, i, rng.choice([None, rng.randrange(50)]) if i % 17 == 0 else rng.randrange(50)))
    rows.append((None, 5000, 1))
    rows.append((None, 5001, 2))
    return rows, spark.createDataFrame(rows, "k string, pos int, v int").repartition(6)


def test_running_numbers_and_sums(skewed):
    rows, df = skewed
    got = ordered.running(df, ["k"], ["pos"], number="rn", sums={"total": "v"}).collect()
    want = {}
    for k in {r[0] for r in rows}:
        total = 0
        for n, (_, pos, v) in enumerate(sorted(r for r in rows if r[0] == k), 1) if k else enumerate(
            [r for r in rows if r[0] is None], 1
        ):
            total += v or 0
            want[(k, pos)] = (n, total)
    assert len(got) == len(rows)
    assert {(r.k, r.pos): (r.rn, r.total or 0) for r in got} == want


def test_global_numbering(skewed):
    rows, df = skewed
    got = ordered.number_rows(df, ["pos"], "seq").collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.seq)] == sorted(r[1] for r in rows)
    assert sorted(r.seq for r in got) == list(range(1, len(rows) + 1))


def test_previous_crosses_partitions(skewed):
    rows, df = skewed
    got = ordered.previous(df.filter("k is not null"), ["k"], ["pos"], {"before": "v"}).collect()
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        last, first = None, True
        for _, pos, v in sorted(r for r in rows if r[0] == k):
            want[(k, pos)] = (last, first)
            last, first = v, False
    assert {(r.k, r.pos): (r.before, r.is_first) for r in got} == want


@pytest.mark.parametrize("parts", [2, 100, 1 << 20])
def test_percentiles_match_numpy(spark, monkeypatch, parts):
    monkeypatch.setattr(percentiles, "_PARTS", parts)
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 10**6, 30_000) / 100
    tiny = np.array([1.0, 2.0])
    rows = [("hot", float(x)) for x in hot] + [("tiny", float(x)) for x in tiny] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    qs = [Quantile("p50", F.col("v"), 0.5), Quantile("p95", F.col("v"), 0.95), Quantile("p0", F.col("v"), 0.0)]
    got = {r.k: r for r in percentiles.grouped(df, ["k"], [F.count("v").alias("n")], qs).collect()}
    for k, values in (("hot", hot), ("tiny", tiny)):
        assert got[k].n == len(values)
        assert got[k].p50 == pytest.approx(np.quantile(values, 0.5), abs=1e-9)
        assert got[k].p95 == pytest.approx(np.quantile(values, 0.95), abs=1e-9)
        assert got[k].p0 == values.min()
    assert got["none"].n == 0 and got["none"].p50 is None
    flat = percentiles.grouped(df, [], [F.count(F.lit(1)).alias("n")], qs[:1]).head()
    both = np.concatenate([hot, tiny])
    assert flat.n == len(both) + 1 and flat.p50 == pytest.approx(np.quantile(both, 0.5), abs=1e-9)


def test_percentiles_of_any_doubles(spark):
    rng = np.random.default_rng(9)
    wild = np.concatenate([
        rng.choice([-1, 1], 300) * 2.0 ** rng.uniform(-1070, 1020, 300), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, np.finfo(float).max],
        1 + np.arange(40) * 2.0**-52, np.full(200, 7.0),
    ])
    rows = [(k, float(x), float(-x)) for k in ("a", None) for x in rng.permutation(wild)] + [("nan", float("nan"), 1.0), ("nan", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    v, w = F.col("v"), F.col("w")
    qs = [Quantile(f"v{p}", v, p) for p in (0.0, 0.25, 0.5, 1.0)] + [Quantile("w50", w, 0.5)]
    got = {r.k: r for r in percentiles.grouped(df, ["k"], [], qs).collect()}
    assert set(got) == {"a", None, "nan"}
    def exact(values, p):
        at, ordered = (len(values) - 1) * p, np.sort(values)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        return low if low == high else low + (high - low) * (at - np.floor(at))

    for k in ("a", None):
        for p in (0.0, 0.25, 0.5, 1.0):
            assert got[k][f"v{p}"] == exact(wild, p)
        assert got[k].w50 == exact(-wild, 0.5)
    assert got["nan"]["v0.0"] == 1.0 and np.isnan(got["nan"]["v1.0"]) and got["nan"].w50 == 1.0
    assert percentiles.grouped(df.limit(0), ["k"], [], qs).count() == 0
    alone = percentiles.grouped(df.filter("k = 'a'"), [], [], qs).collect()
    assert len(alone) == 1 and alone[0]["v0.5"] == exact(wild, 0.5)


def _graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closure_ends_on_cycles_and_visits_diamonds_once(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "y")])
    start = spark.createDataFrame([("a",)], "dst string")
    got = {r.dst: r.hop for r in reach.closure(edges, start).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2}


def test_closure_stops_but_shows_stop_nodes(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    start = spark.createDataFrame([("a",)], "dst string")
    stop = spark.createDataFrame([("b",)], "dst string")
    got = {r.dst for r in reach.closure(edges, start, stop=stop).collect()}
    assert got == {"a", "b"}


def test_closure_is_transitive(spark):
    rng = random.Random(1)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60))}
    adjacent = {}
    for a, b in pairs:
        adjacent.setdefault(a, set()).add(b)
    starts = ["n1", "n2", "n3"]
    want = set()
    for s in starts:
        seen, todo = {s}, [s]
        while todo:
            for nxt in adjacent.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        want |= {(s, n) for n in seen}
    df = spark.createDataFrame([(s, s) for s in starts], "dst string, root string")
    got = {(r.root, r.dst) for r in reach.closure(_graph(spark, sorted(pairs)), df, carry=["root"]).collect()}
    assert got == want


def test_longest_path_with_cycles_and_long_chains(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("out", "a")])
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r.id: r.depth for r in reach.longest_path(edges, nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    loop = _graph(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "c")])
    assert {r.id: r.depth for r in reach.longest_path(loop, nodes).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_spread_takes_the_earliest_label(spark):
    edges = _graph(spark, [("t1", "m"), ("t2", "m"), ("m", "s"), ("t2", "z")])
    labels = spark.createDataFrame([("t1", 5), ("t2", 3), ("s", 4)], "id string, label int")
    got = {r.id: r.label for r in reach.spread(edges, labels).collect()}
    assert got == {"t1": 5, "t2": 3, "m": 3, "s": 3, "z": 3}


def test_spread_max_and_cycles_of_pointers(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c")])
    labels = spark.createDataFrame([("a", 9), ("b", 1)], "id string, label int")
    got = {r.id: r.label for r in reach.spread(edges, labels, keep="max").collect()}
    assert got == {"a": 9, "b": 9, "c": 9}
    pointers = spark.createDataFrame(
        [("p", "q"), ("q", "r"), ("r", "q"), ("s", "s"), ("t", None), ("u", "t")], "id string, next string"
    )
    assert {r.id for r in reach.on_cycles(pointers).collect()} == {"q", "r", "s"}


def test_cycles_name_their_members_whatever_hangs_on_them(spark):
    rng = np.random.default_rng(2)
    after = {f"t{k}": f"t{k + 1}" for k in range(70)} | {"t70": "c0"} | {f"c{k}": f"c{(k + 1) % 11}" for k in range(11)}
    after |= {"self": "self", "a": "b", "b": "a", "x": "self", "end": None, "to_end": "end"}
    after |= {f"n{k}": f"n{rng.integers(60)}" for k in range(60)}
    pointers = spark.createDataFrame(list(after.items()), "id string, next string")

    def members(start):
        walk, at = [], start
        while at is not None and at not in walk:
            walk.append(at)
            at = after.get(at)
        return walk if at == start else None

    want = {k: min(m) for k in after if (m := members(k))}
    assert {r.id: r.cycle for r in reach.on_cycles(pointers).collect()} == want
    assert reach.on_cycles(pointers.filter("id like 't%'")).count() == 0


def _exchanges_over(df, column):
    """Shuffles in the plan that move rows by a column of the given name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" + column in line]


def test_laid_out_edges_are_joined_where_they_are(spark):
    edges = _graph(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("a", "c")])
    laid = durable.cut_by(edges, ["src"], distinct=True)
    frontier = spark.createDataFrame([("a",)], "id string").hint("merge")
    assert sorted(laid.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert _exchanges_over(frontier.join(edges, F.col("id") == F.col("src")), "src")
    met = frontier.join(laid, F.col("id") == F.col("src"))
    assert not _exchanges_over(met, "src") and met.count() == 2


def test_closure_enters_listed_nodes_only_and_leaves_the_edges_alone(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "y")])
    start, listed = spark.createDataFrame([("a",)], "dst string"), spark.createDataFrame([("b",), ("b",), ("c",), ("y",)], "dst string")
    got = sorted((r.dst, r.hop) for r in reach.closure(edges, start, within=listed).collect())
    assert got == [("a", 0), ("b", 1), ("c", 2)]


def test_spread_tells_what_edges_bring(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("d", "d")])
    labels = spark.createDataFrame([("a", 5), ("b", 9), ("d", 1)], "id string, label int")
    got = {r.id: (r.label, r.came) for r in reach.spread(edges, labels, keep="max").collect()}
    assert got == {"a": (5, None), "b": (9, 5), "c": (9, 9), "d": (1, 1)}


def test_longest_path_drops_edges_that_leave_or_repeat(spark):
    edges = _graph(spark, [("a", "b"), ("a", "b"), ("a", "out"), ("out", "c"), ("b", "c")])
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    for given in (edges, durable.cut_by(edges, ["src"])):
        assert sorted((r.id, r.depth) for r in reach.longest_path(given, nodes).collect()) == [("a", 0), ("b", 1), ("c", 2)]
