"""Data-quality rules: the failing rows of a check, many checks in few scans, scores and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import status as st
from millrace.functions import texts, times
from millrace.functions.numbers import percent
from millrace.sources import tables

# ---------------------------------------------------------------- checks on data: failing rows


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose value (combination) occurs more than once; a null in it never fails."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.filter(present).join(repeated_values(df, *cols), list(cols), "left_semi")


def repeated_values(df: DataFrame, *cols: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    counted = df.filter(present).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > 1)


def accepted_values(df: DataFrame, col: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value is not in the list; a null row passes, a null in the list allows nothing more."""
    known = [v for v in values if v is not None]
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(known))


def relationships(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    keys = parent.select(F.col(parent_col).alias("_parent_key"))
    return df.filter(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_parent_key"), "left_anti")


def accepted_range(
    df: DataFrame, col: str, min_value: Any = None, max_value: Any = None
) -> DataFrame:
    return df.filter(_outside(col, min_value, max_value))


def _outside(col: str, lo: Any, hi: Any) -> Column:
    out = F.lit(False)
    if lo is not None:
        out = out | (F.col(col) < lo)
    if hi is not None:
        out = out | (F.col(col) > hi)
    return F.coalesce(out, F.lit(False))


def freshness(df: DataFrame, col: str, *, max_age_hours: float, as_of: str | None) -> DataFrame:
    """One row with the newest time when it is older than the limit (or missing), else none."""
    newest = df.agg(F.max(times.as_time(col)).alias("newest"))
    age = (F.unix_seconds(times.clock(as_of)) - F.unix_seconds("newest")) / 3600
    return newest.filter(F.col("newest").isNull() | (age > max_age_hours))


def custom_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Every returned row is a failure; tables are referenced as ``{name}``."""
    return spark.sql(sql, **tables)


# ---------------------------------------------------------------- many rules at once

_FUSED = ("not_null", "accepted_values", "accepted_range")


def rules_in_scope(rules: Sequence[Mapping[str, Any]], scope: str = "all") -> list[Mapping[str, Any]]:
    """All rules, one model's rules, or — given a rule — every rule on that rule's model."""
    if scope == "all":
        return list(rules)
    models = {r["model"] for r in rules}
    if scope in models:
        return [r for r in rules if r["model"] == scope]
    model = next((r["model"] for r in rules if r["id"] == scope), None)
    if model is None:
        raise KeyError(scope)
    return [r for r in rules if r["model"] == model]


def run_rules(
    tables: Mapping[str, DataFrame],
    rules: Sequence[Mapping[str, Any]],
    *,
    scope: str = "all",
    as_of: str | None = None,
    count: str = "rows",
) -> DataFrame:
    """Status and failure count per rule.

    Row-local checks of one table share a single aggregate scan; checks that need a grouping or a
    join each get their own. ``count='values'`` counts repeated values instead of their rows.
    """
    chosen = rules_in_scope(rules, scope)
    if absent := sorted({r["model"] for r in chosen if r.get("enabled", True)} - set(tables)):
        raise KeyError(f"no table for {', '.join(absent)}")
    parts: list[DataFrame] = []
    for model, df in tables.items():
        mine = [r for r in chosen if r["model"] == model and r.get("enabled", True)]
        fused = [r for r in mine if r["check"] in _FUSED]
        if fused:
            one = df.agg(*[F.count_if(_local_failure(r)).alias(f"r{i}") for i, r in enumerate(fused)])
            rows = F.array(*[
                F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"r{i}").alias("failures"))
                for i, r in enumerate(fused)
            ])
            parts.append(one.select(F.inline(rows)))
        for r in mine:
            if r["check"] not in _FUSED:
                counted = _own_job(df, r, tables, as_of, count)
                parts.append(counted.select(F.lit(r["id"]).alias("rule_id"), "failures"))
    spark = next(iter(tables.values())).sparkSession
    catalog = spark.createDataFrame(
        [(r["id"], r["model"], r.get("severity", "error"), bool(r.get("enabled", True))) for r in chosen],
        "rule_id string, model string, severity string, enabled boolean",
    )
    if not parts:
        measured = spark.createDataFrame([], "rule_id string, failures long")
    else:
        measured = reduce(DataFrame.unionByName, parts)
    failures = F.col("failures").cast("long")
    return catalog.join(measured, "rule_id", "left").select(
        "rule_id", "model", "severity",
        F.when(~F.col("enabled") | failures.isNull(), "unknown").when(failures == 0, "ok")
        .when(F.col("severity") == "error", "err").otherwise("warn").alias("status"),
        failures.alias("failures"),
    )


def _local_failure(rule: Mapping[str, Any]) -> Column:
    col = rule["col"]
    if rule["check"] == "not_null":
        return F.col(col).isNull()
    if rule["check"] == "accepted_values":
        return F.col(col).isNotNull() & ~F.col(col).isin(list(rule["values"]))
    return _outside(col, rule.get("min_value"), rule.get("max_value"))


def _own_job(
    df: DataFrame, rule: Mapping[str, Any], tables: Mapping[str, DataFrame],
    as_of: str | None, count: str,
) -> DataFrame:
    check = rule["check"]
    if check in ("unique", "unique_combination"):
        cols = [rule["col"]] if check == "unique" else list(rule["cols"])
        measure = F.count(F.lit(1)) if count == "values" else F.coalesce(F.sum("n"), F.lit(0))
        return repeated_values(df, *cols).agg(measure.alias("failures"))
    if check == "relationships":
        bad = relationships(df, rule["col"], tables[rule["to"]], rule["field"])
    elif check == "freshness":
        bad = freshness(df, rule["col"], max_age_hours=rule["max_age_hours"], as_of=as_of)
    elif check == "custom_sql":
        bad = custom_sql(df.sparkSession, rule["sql"], **tables)
    else:
        raise ValueError(f"unknown check {check!r}")
    return bad.agg(F.count(F.lit(1)).alias("failures"))


# ---------------------------------------------------------------- result history


def history_from_tests(tests: DataFrame, *, as_of: str | None, days: int = 90) -> DataFrame:
    """Test-result history as rule results; the run id is made from the time of the check."""
    ts = times.as_time("detected_at")
    at = F.unix_micros(ts) / F.lit(1_000_000)
    return tests.filter(times.within_days(ts, days, as_of) & F.col("test_unique_id").isNotNull()).select(
        F.col("test_unique_id").alias("rule_uid"),
        F.concat(F.lit("el:"), F.unix_seconds(ts).cast("string")).alias("run_id"),
        st.test_state(F.col("status")).alias("status"),
        F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
        at.cast("double").alias("ran_at"),
    )


def latest_per_key(
    results: DataFrame, key: str = "rule_uid", at: str = "ran_at", tie: str = "run_id"
) -> DataFrame:
    """Newest row per key by partial aggregation; equal times fall to the larger tie column."""
    rest = [c for c in results.columns if c not in (key, at, tie)]
    newest = F.max(F.struct(F.col(at), F.col(tie), *[F.col(c) for c in rest])).alias("_r")
    return results.groupBy(key).agg(newest).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in results.columns if c != key]
    )


def rules_state(
    rules: DataFrame, current: DataFrame, history: DataFrame
) -> DataFrame:
    """Every rule per model with its last known result.

    ``current(uid, status, failures)`` is the latest run's raw result, ``history`` the stored rule
    results. A disabled rule is unknown; one never measured is unknown as well.
    """
    latest = latest_per_key(history).select(
        F.col("rule_uid").alias("_h_uid"), F.col("status").alias("_h_status"),
        F.col("failures").alias("_h_failures"), F.col("ran_at").alias("_h_at"),
    )
    now = current.select(
        F.col("uid").alias("_c_uid"), F.col("status").alias("_c_status"),
        F.col("failures").alias("_c_failures"),
    )
    joined = (
        rules.withColumn("model_id", F.explode("targets"))
        .join(now, F.col("uid") == F.col("_c_uid"), "left")
        .join(latest, F.col("uid") == F.col("_h_uid"), "left")
    )
    ran = F.col("_c_uid").isNotNull()
    rtype = st.rule_type(F.col("check_name"))
    return joined.select(
        F.col("name").alias("rule_id"), "uid", rtype.alias("type"),
        st.dimension(rtype).alias("dimension"), "model_id", "col",
        texts.condition_text(F.col("check_name"), F.col("args")).alias("cond"),
        texts.condition_text(F.col("check_name"), F.col("args"), shown=None).alias("cond_all"),
        F.when(F.col("severity") == "error", "error").otherwise("warn").alias("sev"),
        F.col("enabled").alias("active"), "singular",
        F.when(~F.col("enabled"), "unknown").when(ran, st.test_state(F.col("_c_status")))
        .otherwise(F.coalesce("_h_status", F.lit("unknown"))).alias("status"),
        F.when(F.col("enabled"), F.coalesce(F.when(ran, F.col("_c_failures")).otherwise(F.col("_h_failures")), F.lit(0)))
        .otherwise(F.lit(0)).cast("long").alias("cnt"),
        F.when(~ran, F.col("_h_at")).alias("measured_at"),
    )


def rule_filters(
    state: DataFrame, *, type: str | None = None, model: str | None = None,
    dimension: str | None = None, search: str | None = None,
    page: int | None = None, page_size: int = 10,
) -> DataFrame:
    """Equality filters on type (key or label), model and dimension, search, then one page."""
    out = state
    if type:
        out = out.filter((F.col("type") == type) | (st.rule_label(F.col("type")) == type))
    if model:
        out = out.filter(F.col("model_id") == model)
    if dimension:
        out = out.filter(F.col("dimension") == dimension)
    if search:
        out = out.filter(texts.contains_any(search, [F.col(c) for c in ("rule_id", "col", "model_id", "cond")]))
    if page:
        out = out.orderBy("rule_id", "model_id").offset((page - 1) * page_size).limit(page_size)
    return out


# ---------------------------------------------------------------- scores


def _known() -> Column:
    return F.col("active") & (F.col("status") != "unknown")


def dashboard(state: DataFrame) -> DataFrame:
    """One row of totals; rules never measured leave the denominator, and no measurement is no score."""
    on = state.filter("active")
    bad = F.col("status").isin("err", "warn")
    agg = on.agg(
        F.count(F.lit(1)).alias("rule_total"),
        F.count_if(_known()).alias("measured"),
        F.count_if(F.col("status") == "ok").alias("passed"),
        F.count_if(F.col("status") == "err").alias("err_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"),
        F.coalesce(F.sum(F.when(bad, F.col("cnt"))), F.lit(0)).alias("err_rows"),
        F.count_if(bad & (F.col("cnt") > 0)).alias("err_rule_count"),
        F.count_if(~_known()).alias("not_run_count"),
        F.count_distinct(F.when(bad, F.col("model_id"))).alias("affected_models"),
    )
    return agg.withColumn("score", percent(F.col("passed"), F.col("measured")))


def affected_models(state: DataFrame) -> DataFrame:
    return violations_list(state).select("model_id").distinct()


def quality_by_model(state: DataFrame) -> DataFrame:
    mine = F.col("active")
    return state.groupBy("model_id").agg(
        F.count_if(mine).alias("rule_count"),
        F.count_if(mine & (F.col("status") == "ok")).alias("passed"),
        st.worst(F.when(mine, F.col("status"))).alias("status"),
    )


def quality_score(state: DataFrame, by: str) -> DataFrame:
    """Share of measured active targets that pass, per model or per dimension."""
    scored = state.groupBy(by).agg(
        F.count_if(_known()).alias("measured"),
        F.count_if(_known() & (F.col("status") == "ok")).alias("passed"),
    )
    return scored.withColumn("score", percent(F.col("passed"), F.col("measured"), digits=2))


def lowest_models(state: DataFrame, k: int = 6, target: float = 90.0) -> DataFrame:
    """The k lowest measured models, each row also naming how many lie below the target."""
    scored = quality_score(state, "model_id").filter("measured > 0")
    below = scored.agg(F.count_if(F.col("score") < target).alias("n")).select("n").scalar()
    return scored.orderBy("score", "model_id").limit(k).withColumn("below_target", below)


def quality_matrix(state: DataFrame) -> DataFrame:
    """Model × dimension scores plus the overall score; an unmeasured cell is null."""
    scored = state.groupBy("model_id", "dimension").agg(
        F.count_if(_known()).alias("n"), F.count_if(_known() & (F.col("status") == "ok")).alias("p")
    )
    dims = list(st.DIMENSIONS.values())
    of = lambda c, d: F.max(F.when(F.col("dimension") == d, F.col(c))).alias(f"_{c}_{d}")
    wide = scored.groupBy("model_id").agg(
        F.sum("n").alias("_n"), F.sum("p").alias("_p"), *[of(c, d) for d in dims for c in ("n", "p")]
    ).filter("_n > 0")
    return wide.select(
        "model_id",
        *[percent(F.col(f"_p_{d}"), F.col(f"_n_{d}"), digits=2).alias(d) for d in dims],
        percent(F.col("_p"), F.col("_n"), digits=2).alias("overall"),
    )


def present_dimensions(state: DataFrame) -> DataFrame:
    """Dimensions that have any rule: the columns a matrix should show."""
    return state.select("dimension").distinct()


def failure_mix(state: DataFrame) -> DataFrame:
    """Failing rows per rule type with their share; types without failures are dropped."""
    mixed = (
        state.filter("active").groupBy("type").agg(F.sum("cnt").alias("rows")).filter("rows > 0")
    )
    total = F.sum("rows").over(Window.partitionBy())  # at most one row per rule type
    return mixed.select("type", "rows", percent(F.col("rows"), total, digits=2).alias("share"))


def group_rules(state: DataFrame) -> DataFrame:
    """Rules folded by (whole condition, severity), singular ones by name, one row per group.

    Members stay in rows of their own (:func:`group_members`), so a group of any size is only
    counted here, never gathered.
    """
    bad = F.col("active") & F.col("status").isin("err", "warn")
    grouped = group_members(state).groupBy("key").agg(
        F.min("type").alias("type"), F.min("cond").alias("cond"), F.min("sev").alias("sev"),
        F.max("singular").alias("singular"),
        F.count(F.lit(1)).alias("targets"),
        F.count_distinct("model_id").alias("models"),
        F.count_if("active").alias("active_targets"),
        F.count_if(bad).alias("fail_targets"),
        F.count_if(F.col("active") & (F.col("status") == "err")).alias("_err"),
        F.count_if(F.col("active") & (F.col("status") == "warn")).alias("_warn"),
        F.count_if(_known()).alias("measured"),
        F.count_if(_known() & (F.col("status") == "ok")).alias("_ok"),
        F.coalesce(F.sum(F.when(F.col("active"), F.col("cnt"))), F.lit(0)).alias("err_rows"),
    )
    state_of = (
        F.when(F.col("active_targets") == 0, "off").when(F.col("_err") > 0, "err")
        .when(F.col("_warn") > 0, "warn").when(F.col("measured") == 0, "notrun").otherwise("ok")
    )
    shaped = grouped.withColumn("status", state_of).withColumn("rid0", texts.group_number(F.col("key")))
    rank = status_rank(F.col("status"))
    # Keys are distinct and the number is a hash of them, so these partitions stay even.
    clash = Window.partitionBy("rid0").orderBy(rank, "cond", "key")
    n = F.row_number().over(clash)
    return shaped.select(
        F.when(n == 1, F.col("rid0")).otherwise(F.concat("rid0", F.lit("-"), n.cast("string"))).alias("rid"),
        "key", "type", "cond", "sev", "singular", "targets", "models", "active_targets",
        "fail_targets", "err_rows", "status", "measured",
        percent(F.col("_ok"), F.col("measured"), digits=2).alias("score"),
    )


# What needs attention comes first.
STATUS_ORDER = {"err": 0, "warn": 1, "notrun": 2, "ok": 3, "off": 4}


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for name, i in STATUS_ORDER.items():
        out = F.when(status == name, F.lit(i)).otherwise(out)
    return out


def group_members(state: DataFrame) -> DataFrame:
    key = F.when(F.col("singular"), F.concat(F.lit("S:"), "rule_id")).otherwise(
        F.concat(F.lit("G:"), "cond_all", F.lit("|"), "sev")
    )
    return state.withColumn("key", key)


def group_filters(
    groups: DataFrame, members: DataFrame, *, status: str | None = None, model: str | None = None, dimension: str | None = None,
    search: str | None = None, page: int | None = None, page_size: int = 10,
) -> DataFrame:
    """Groups of a status, with a target in a model, of a dimension, matching a search; then one page.

    A search looks at the group's number, condition and kind and at the column and model of every member. Members are
    only ever asked for the keys of the groups they are in.
    """
    out = groups if status is None else groups.filter(F.col("status") == status)
    for column, wanted in (("model_id", model), ("dimension", dimension)):
        if wanted is not None:
            out = out.join(members.filter(F.col(column) == wanted).select("key").distinct(), "key", "left_semi")
    if search:
        inside = members.filter(texts.contains_any(search, [F.col(c) for c in ("col", "model_id")])).select("key").distinct()
        own = texts.contains_any(search, [F.col("rid"), F.col("cond"), st.rule_label(F.col("type"))])
        met = inside.withColumnRenamed("key", "_key")
        out = out.join(met, out["key"] == met["_key"], "left").filter(own | F.col("_key").isNotNull()).drop("_key")
    if page:
        out = ordered_groups(out).offset((page - 1) * page_size).limit(page_size)
    return out


def ordered_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(status_rank(F.col("status")), "cond", "key")


def top_failing_rules(groups: DataFrame, k: int = 6) -> DataFrame:
    return groups.filter("err_rows > 0").orderBy(F.col("err_rows").desc(), "key").limit(k)


def merge_histories(
    tests: DataFrame, members: DataFrame, *, days: int, as_of: str | None, tie: str, limit: int | None = 200
) -> DataFrame:
    """The newest results of every test in a group, newest first; results of one moment go by ``tie``, the larger first.

    ``limit`` is per test, None for all of them.
    """
    ts = times.as_time("detected_at")
    recent = tests.filter(times.within_days(ts, days, as_of)).join(
        members.select(F.col("rule_id").alias("test_name")).distinct(), "test_name", "left_semi"
    )
    if limit is not None:
        newest = Window.partitionBy("test_unique_id").orderBy(ts.desc(), F.col(tie).desc())
        recent = recent.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit).drop("_rn")
    return recent.orderBy(ts.desc(), "test_name")


def daily_pass_rate(
    results: DataFrame, *, days: int, as_of: str | None, tz: str = "UTC", only: DataFrame | None = None
) -> DataFrame:
    """Per local day: each rule counts once with that day's last result; empty days have no row."""
    at = F.timestamp_micros(F.round(F.col("ran_at") * 1_000_000).cast("long"))
    rows = results.filter(times.within_days(at, days, as_of)).withColumn("day", times.local_day(at, tz))
    if only is not None:
        rows = rows.join(only.select("rule_uid").distinct(), "rule_uid", "left_semi")
    last = rows.groupBy("rule_uid", "day").agg(
        F.max(F.struct("ran_at", "run_id", "status")).alias("_r")
    )
    ok = F.col("_r.status") == "ok"
    return last.groupBy("day").agg(
        F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("known")
    ).select(
        F.col("day").cast("string").alias("date"), "passed", "known",
        percent(F.col("passed"), F.col("known")).alias("score"),
    )


# ---------------------------------------------------------------- consequences and reports


def violations_list(state: DataFrame) -> DataFrame:
    return state.filter(F.col("active") & F.col("status").isin("err", "warn"))


def rule_report(state: DataFrame) -> DataFrame:
    """The report's eight columns."""
    return state.select(
        F.col("rule_id").alias("rule"), F.col("model_id").alias("model"), F.col("col").alias("column"),
        st.rule_label(F.col("type")).alias("check_type"), F.col("sev").alias("severity"),
        "status", F.col("cnt").alias("count"), F.col("cond").alias("condition"),
    )


#: The headings of the exported report, in its order.
REPORT_HEADINGS = {
    "rule": "규칙", "model": "대상 모델", "column": "컬럼", "check_type": "검사 유형",
    "severity": "심각도", "status": "결과", "count": "위반 건수", "condition": "검사 방식",
}


def export_report(state: DataFrame, path: str) -> None:
    """The report as CSV files with the headings above and a BOM each; a missing value is an empty cell."""
    report = rule_report(state)
    tables.export_csv(report.select(*[F.col(c).cast("string").alias(h) for c, h in REPORT_HEADINGS.items()]), path)


def failed_models(state: DataFrame) -> DataFrame:
    """Models an error-level rule failed on: where a run stops."""
    hit = (F.col("sev") == "error") & (F.col("status") == "err") & F.col("active")
    return state.filter(hit).select(F.col("model_id").alias("id")).distinct()


def skip_downstream(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Run state per model: failed ones ``err``, everything downstream of them ``skip``, else ``ok``."""
    from millrace.plans.reach import closure

    reached = closure(edges, failed.select(F.col("id").alias("dst")))
    hit = reached.groupBy(F.col("dst").alias("_id")).agg(F.min("hop").alias("_hop"))
    return nodes.select("id").join(hit, F.col("id") == F.col("_id"), "left").select(
        "id",
        F.when(F.col("_hop") == 0, "err").when(F.col("_hop") > 0, "skip").otherwise("ok").alias("state"),
    )
