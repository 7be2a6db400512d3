"""Statistics over run, node and test history.

History tables keep times as text and grow without bound, so every operator filters on the parsed
time first and aggregates in one scan; lists are cut with a top-k sort, never a full one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import status as st
from millrace.functions import times
from millrace.functions.numbers import half_up, percent
from millrace.plans import percentiles
from millrace.plans.percentiles import Quantile

_SECONDS = "execution_time"


def since_days(df: DataFrame, col: str, days: int, as_of: str | None) -> DataFrame:
    return df.filter(times.within_days(times.as_time(col), days, as_of))


def _builds(status: str | None = None, extra: Column | None = None) -> Column:
    cond = st.is_build(F.col("resource_type"))
    if status == "bad":
        cond = cond & st.is_bad(F.col("status"))
    return cond if extra is None else cond & extra


def _tests(*status: str, extra: Column | None = None) -> Column:
    cond = st.is_test(F.col("resource_type"))
    if status:
        cond = cond & F.col("status").isin(*status)
    return cond if extra is None else cond & extra


def _node_measures(suffix: str = "", extra: Column | None = None) -> list[Column]:
    seconds = F.sum(F.when(_builds(extra=extra), F.col(_SECONDS).cast("double")))
    return [
        F.count_if(_builds(extra=extra)).alias(f"node_runs{suffix}"),
        F.count_if(_builds("bad", extra=extra)).alias(f"node_fails{suffix}"),
        half_up(seconds, 1).alias(f"build_seconds{suffix}"),
        F.count_if(_tests(extra=extra)).alias(f"test_runs{suffix}"),
        F.count_if(_tests("pass", extra=extra)).alias(f"test_pass{suffix}"),
        F.count_if(_tests("warn", extra=extra)).alias(f"test_warn{suffix}"),
        F.count_if(_tests("fail", "error", extra=extra)).alias(f"test_fail{suffix}"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    runs, fails = F.col("node_runs"), F.col("node_fails")
    return df.withColumn("success_rate", percent(runs - fails, runs)).withColumn(
        "test_pass_rate", percent(F.col("test_pass"), F.col("test_runs"))
    )


def summary(invocations: DataFrame, results: DataFrame, *, days: int, as_of: str | None) -> DataFrame:
    """One row: runs, first and last run, commands, node and test counts, rates."""
    started = times.as_time("run_started_at")
    inv = since_days(invocations, "run_started_at", days, as_of).agg(
        F.count(F.lit(1)).alias("runs"), F.min(started).alias("first_run"),
        F.max(started).alias("last_run"), F.count_distinct("command").alias("commands"),
    )
    nodes = since_days(results, "generated_at", days, as_of).agg(*_node_measures())
    head = inv.select(F.struct("*").alias("i")).scalar()
    return _rates(nodes.withColumn("_i", head).select("*", "_i.*").drop("_i")).withColumn(
        "days", F.lit(days)
    )


def two_span_summary(
    invocations: DataFrame, results: DataFrame, *, short: int = 1, long: int = 7, as_of: str | None
) -> DataFrame:
    """The summary for two windows from one scan of each table (no command count)."""
    started, made = times.as_time("run_started_at"), times.as_time("generated_at")
    spans = ((short, "_s"), (long, "_l"))
    inv_aggs, node_aggs = [], []
    for days, sfx in spans:
        inside = times.within_days(started, days, as_of)
        inv_aggs += [
            F.count_if(inside).alias(f"runs{sfx}"),
            F.min(F.when(inside, started)).alias(f"first_run{sfx}"),
            F.max(F.when(inside, started)).alias(f"last_run{sfx}"),
        ]
        node_aggs += _node_measures(sfx, times.within_days(made, days, as_of))
    inv = since_days(invocations, "run_started_at", long, as_of).agg(*inv_aggs)
    head = inv.select(F.struct("*").alias("i")).scalar()
    wide = since_days(results, "generated_at", long, as_of).agg(*node_aggs).withColumn("_i", head)
    wide = wide.select("*", "_i.*").drop("_i")
    names = [c.removesuffix("_s") for c in wide.columns if c.endswith("_s")]
    stacked = wide.select(F.inline(F.array(*[
        F.struct(F.lit(days).alias("days"), *[F.col(f"{n}{sfx}").alias(n) for n in names])
        for days, sfx in spans
    ])))
    return _rates(stacked)


def _slow_measures(sfx: str = "", inside: Column | None = None) -> list[Column]:
    sec = F.col(_SECONDS).cast("double")
    kept = sec if inside is None else F.when(inside, sec)
    n = F.count(F.lit(1)) if inside is None else F.count_if(inside)
    return [
        n.alias(f"runs{sfx}"), half_up(F.sum(kept), 1).alias(f"total_seconds{sfx}"),
        half_up(F.avg(kept), 2).alias(f"avg_seconds{sfx}"), half_up(F.max(kept), 2).alias(f"max_seconds{sfx}"),
    ]


def _share(df: DataFrame, *by: str) -> DataFrame:
    """Share of the total of the returned rows; they are already limited, so the window is small."""
    total = F.sum("total_seconds").over(Window.partitionBy(*by))
    return df.withColumn("share", percent(F.col("total_seconds"), total, empty=0.0))


def slowest_models(results: DataFrame, *, days: int, as_of: str | None, limit: int = 10) -> DataFrame:
    """Top models by total seconds, ties by name, with their share of the listed total."""
    rows = since_days(results, "generated_at", days, as_of).filter(_builds())
    ranked = rows.groupBy("name").agg(*_slow_measures()).orderBy(
        F.col("total_seconds").desc_nulls_last(), "name"
    )
    return _share(ranked.limit(limit))


def two_span_slowest(
    results: DataFrame, *, short: int = 1, long: int = 7, as_of: str | None, limit: int = 100
) -> DataFrame:
    """The slowest list of two windows from one scan; a model without runs in a window is not in it."""
    made = times.as_time("generated_at")
    aggs = _slow_measures("_s", times.within_days(made, short, as_of)) + _slow_measures(
        "_l", times.within_days(made, long, as_of)
    )
    wide = since_days(results, "generated_at", long, as_of).filter(_builds()).groupBy("name").agg(*aggs)
    names = ("runs", "total_seconds", "avg_seconds", "max_seconds")
    stacked = wide.select("name", F.inline(F.array(*[
        F.struct(F.lit(d).alias("days"), *[F.col(f"{n}{s}").alias(n) for n in names])
        for d, s in ((short, "_s"), (long, "_l"))
    ]))).filter("runs > 0")
    order = Window.partitionBy("days").orderBy(F.col("total_seconds").desc_nulls_last(), "name")
    # The rank filter lets Spark keep only `limit` rows per window before the shuffle.
    kept = stacked.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")
    return _share(kept, "days")


def spans_agree(
    invocations: DataFrame, results: DataFrame, *, short: int = 1, long: int = 7,
    as_of: str | None, limit: int = 100,
) -> DataFrame:
    """Do the one-scan forms equal the separate queries? One row per check with its differences."""
    both = two_span_summary(invocations, results, short=short, long=long, as_of=as_of)
    slow = two_span_slowest(results, short=short, long=long, as_of=as_of, limit=limit)
    parts = []
    for days in (short, long):
        alone = summary(invocations, results, days=days, as_of=as_of).select(*both.columns)
        parts.append(_difference(f"summary {days}d", both.filter(F.col("days") == days), alone))
        listed = slowest_models(results, days=days, as_of=as_of, limit=limit)
        merged = slow.filter(F.col("days") == days).select(*listed.columns)
        parts.append(_difference(f"slowest {days}d", merged, listed))
    return reduce(DataFrame.unionByName, parts)


def _difference(label: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on either side only, counted through one grouping of both sides' multiset difference."""
    tagged = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    balance = tagged.groupBy(*a.columns).agg(
        F.sum("_side").alias("_d"), F.count_if(F.col("_side") == 1).alias("_a")
    )
    return balance.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("compared"),
        F.coalesce(F.sum(F.abs("_d")), F.lit(0)).alias("differences"),
    ).select(
        F.lit(label).alias("checked"), "compared", "differences",
        (F.col("differences") == 0).alias("ok"),
    )


def runs_with_nodes(
    invocations: DataFrame, results: DataFrame, *, days: int, as_of: str | None,
    limit: int = 50, command: str | None = None,
) -> DataFrame:
    """Newest runs with node counts; nodes are counted per run before the join."""
    runs = since_days(invocations, "run_started_at", days, as_of)
    if command:
        runs = runs.filter(F.col("command") == command)
    started, ended = times.as_time("run_started_at"), times.as_time("run_completed_at")
    newest = runs.orderBy(started.desc_nulls_last(), "invocation_id").limit(limit)
    nodes = results.groupBy(F.col("invocation_id").alias("_inv")).agg(
        F.count("unique_id").alias("nodes"),
        F.count_if(st.is_bad(F.col("status"))).alias("fails"),
        half_up(F.sum(F.col(_SECONDS).cast("double")), 2).alias("exec_seconds"),
    )
    return newest.join(nodes, F.col("invocation_id") == F.col("_inv"), "left").select(
        *invocations.columns,
        times.elapsed_seconds(started, ended).alias("wall_seconds"),
        F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("fails", F.lit(0)).alias("fails"),
        "exec_seconds",
    )


def run_nodes(results: DataFrame, invocation_id: str) -> DataFrame:
    """One run's nodes, longest first, with the seconds of the compile and execute phases."""
    return (
        results.filter(F.col("invocation_id") == invocation_id)
        .orderBy(F.col(_SECONDS).desc_nulls_last(), "unique_id")
        .withColumns({f"{p}_seconds": _phase(p) for p in _PHASES})
    )


_PHASES = ("compile", "execute")


def _phase(name: str) -> Column:
    return times.elapsed_seconds(
        times.as_time(f"{name}_started_at"), times.as_time(f"{name}_completed_at"), 3
    )


def model_stats(
    results: DataFrame, *, days: int, as_of: str | None, limit: int = 100, catalog: DataFrame | None = None
) -> DataFrame:
    """Per model: counts, exact p50/p95, totals, last run, whether the model still exists."""
    rows = since_days(results, "generated_at", days, as_of).filter(_builds())
    sec = F.col(_SECONDS).cast("double")
    keys = ["name", "unique_id", "resource_type"]
    stats = percentiles.grouped(
        rows, keys,
        [
            F.count(F.lit(1)).alias("runs"), F.count_if(st.is_bad(F.col("status"))).alias("fails"),
            half_up(F.avg(sec), 2).alias("avg_seconds"), half_up(F.max(sec), 2).alias("max_seconds"),
            half_up(F.sum(sec), 1).alias("total_seconds"),
            F.max(times.as_time("generated_at")).alias("last_run_at"),
            F.max("materialization").alias("materialization"),
        ],
        [Quantile("p50_seconds", sec, 0.5), Quantile("p95_seconds", sec, 0.95)],
    )
    top = (
        stats.withColumn("p50_seconds", half_up(F.col("p50_seconds"), 2))
        .withColumn("p95_seconds", half_up(F.col("p95_seconds"), 2))
        .withColumn("fail_rate", percent(F.col("fails"), F.col("runs"), empty=0.0))
        .orderBy(F.col("total_seconds").desc_nulls_last(), *keys)
        .limit(limit)
    )
    if catalog is None:
        return top
    known = catalog.select(F.col("id").alias("_id")).distinct()
    return top.join(known, F.col("name") == F.col("_id"), "left").select(
        *top.columns, F.col("_id").isNotNull().alias("exists")
    )


def model_series(results: DataFrame, name: str, *, days: int, as_of: str | None, limit: int = 100) -> DataFrame:
    """One model's runs, newest first; an unknown name gives no rows."""
    ran = times.as_time("generated_at")
    return (
        since_days(results.filter(F.col("name") == name), "generated_at", days, as_of)
        .withColumns({f"{p}_seconds": _phase(p) for p in _PHASES})
        .orderBy(ran.desc_nulls_last(), "unique_id").limit(limit)
    )


def test_series(tests: DataFrame, name: str, *, days: int, as_of: str | None, limit: int = 100) -> DataFrame:
    ran = times.as_time("detected_at")
    rows = since_days(tests.filter(F.col("test_name") == name), "detected_at", days, as_of)
    return rows.orderBy(ran.desc_nulls_last(), "test_unique_id").limit(limit)


def daily_trend(results: DataFrame, *, days: int, as_of: str | None, tz: str = "UTC") -> DataFrame:
    """Per day with any run; empty days have no row, for zeros would read as failure."""
    day = times.local_day(times.as_time("generated_at"), tz)
    rows = since_days(results, "generated_at", days, as_of).withColumn("date", day.cast("string"))
    grouped = rows.groupBy("date").agg(
        *[m for m in _node_measures()], F.count_distinct("invocation_id").alias("invocations")
    )
    return _rates(grouped).drop("test_warn", "test_fail")


def test_stats(tests: DataFrame, *, days: int, as_of: str | None, limit: int = 200) -> DataFrame:
    """Per test: what it looks at, outcomes, worst failure count, last run and last issue, pass rate."""
    seen = times.as_time("detected_at")
    issue = F.col("status").isin("fail", "error", "warn")
    grouped = since_days(tests, "detected_at", days, as_of).groupBy("test_unique_id", "test_name").agg(
        *[F.max(c).alias(c) for c in ("model_unique_id", "table_name", "column_name", "test_type", "severity")],
        *_test_counts(),
        F.max("failures").alias("max_failures"), F.max(seen).alias("last_run_at"),
        F.max(F.when(issue, seen)).alias("last_issue_at"),
    )
    return (
        grouped.withColumn("pass_rate", percent(F.col("passes"), F.col("runs")))
        .orderBy(F.col("fails").desc(), F.col("warns").desc(), F.col("runs").desc(), "test_unique_id")
        .limit(limit)
    )


def _test_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "pass").alias("passes"),
        F.count_if(F.col("status") == "warn").alias("warns"),
        F.count_if(F.col("status").isin("fail", "error")).alias("fails"),
    ]


def tests_daily(tests: DataFrame, *, days: int, as_of: str | None, tz: str = "UTC") -> DataFrame:
    day = times.local_day(times.as_time("detected_at"), tz)
    rows = since_days(tests, "detected_at", days, as_of).withColumn("date", day.cast("string"))
    return rows.groupBy("date").agg(*_test_counts()).withColumn(
        "pass_rate", percent(F.col("passes"), F.col("runs"))
    )


def recent_failures(results: DataFrame, *, days: int, as_of: str | None, limit: int = 50) -> DataFrame:
    """Newest failing nodes and tests in one list."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    bad = F.col("status").isin("error", "fail", "warn", "skipped")
    ran = times.as_time("generated_at")
    return since_days(results, "generated_at", days, as_of).filter(bad).orderBy(
        ran.desc_nulls_last(), "unique_id"
    ).limit(limit)


def run_trend(runs: DataFrame, *, days: int, tz: str = "UTC") -> DataFrame:
    """Runs per day, ok against err, for the last ``days`` days that have runs."""
    ended = times.as_time(F.coalesce("ended_at", "started_at"))
    grouped = (
        runs.filter(ended.isNotNull()).groupBy(times.local_day(ended, tz).cast("string").alias("date"))
        .agg(F.count_if(F.col("state") == "success").alias("ok"),
             F.count_if(~(F.coalesce("state", F.lit("")) == "success")).alias("err"))
    )
    return grouped.orderBy(F.col("date").desc()).limit(days)


def top_n_with_other(df: DataFrame, key: str, value: str, *, n: int = 5) -> DataFrame:
    """The n largest keys and one row for all others (how many, and total minus the listed)."""
    totals = df.groupBy(key).agg(F.sum(value).alias("total"))
    top = totals.orderBy(F.col("total").desc_nulls_last(), key).limit(n)
    # Everything minus the listed rows: two small aggregates, no global ranking of all keys.
    signed = totals.select(F.col("total").alias("t"), F.lit(1).alias("w")).unionAll(
        top.select((-F.col("total")).alias("t"), F.lit(-1).alias("w"))
    )
    rest = signed.agg(F.sum("t").alias("total"), F.sum("w").alias("members")).filter("members > 0")
    other = rest.select(
        F.lit("other").alias(key), F.greatest("total", F.lit(0.0)).alias("total"), "members"
    )
    whole = totals.agg(F.sum("total").alias("w")).scalar()
    listed = top.select(F.col(key).cast("string").alias(key), "total", F.lit(1).cast("long").alias("members"))
    return listed.unionByName(other).withColumn("pct", percent(F.col("total"), whole, digits=0))


def spike_vs_median(
    results: DataFrame, *, tie: str, value: str = _SECONDS, runs: int = 10, factor: float = 1.5
) -> DataFrame:
    """Per model over its last ``runs`` runs: last value, upper-middle median, max, and the spike flag.

    ``value`` is what is watched, seconds or rows (a missing one counts as 0); runs of one moment go by ``tie``.
    """
    newest = Window.partitionBy("name").orderBy(times.as_time("generated_at").desc(), F.col(tie).desc())
    recent = results.filter(_builds()).withColumn("_rn", F.row_number().over(newest)).filter(
        F.col("_rn") <= runs
    )
    sec = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    # At most `runs` values per model are gathered.
    values = F.sort_array(F.collect_list(sec))
    shaped = recent.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.min_by(sec, "_rn").alias("last_value"),
        values.alias("_v"), F.max(sec).alias("max_value"),
    ).withColumn("median_value", F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int")))
    return shaped.select(
        "name", "runs", "last_value", "median_value", "max_value",
        ((F.col("median_value") != 0) & (F.col("last_value") > F.col("median_value") * factor)).alias("spike"),
    )
