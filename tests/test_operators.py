"""Transforms, specs, quality, lineage and history on small hand-made tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers, status, texts, times
from millrace.operators import analyze as an
from millrace.operators import catalog, history, lineage, quality, storage
from millrace.operators import sqltexts
from millrace.operators import transform as tf
from millrace.plans.durable import fresh_path
from millrace.sources import listing
from millrace.streaming import changes, loads


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("a", 1, 10.0, "x"), ("a", 2, 20.0, None), ("b", 3, 5.0, "y"), ("b", 4, 7.0, "y"), ("c", 5, None, "z")],
        "region string, n int, price double, code string",
    )


# ---------------------------------------------------------------- transforms and specs


def test_pick_falls_back_to_all_columns(sales):
    assert tf.transform({"s": sales}, tf.Form(base="s", cols=["nope"])).columns == sales.columns


def test_form_defaults(sales):
    out = tf.transform({"s": sales}, tf.Form(base="s", agg="sum", cols=["region", "code", "price"]))
    assert out.columns == ["region", "code", "sum_price"]
    assert tf.transform({"s": sales}, tf.Form(base="s", agg="count")).columns == ["region", "n", "row_count"]
    with pytest.raises(ValueError):
        tf.transform({"s": sales}, tf.Form(base="s", agg="mode"))
    with pytest.raises(ValueError):
        tf.transform({"s": sales}, tf.Form(base="s", clean=["polish"]))


def test_grouping_on_clean_keys(spark):
    df = spark.createDataFrame([(" a",), ("A",), ("b",)], "k string")
    raw = tf.transform({"t": df}, tf.Form(base="t", agg="count", clean=["trim", "upper"]))
    clean = tf.transform({"t": df}, tf.Form(base="t", agg="count", clean=["trim", "upper"], group_on="clean"))
    assert sorted(map(tuple, raw.collect())) == [("A", 1), ("A", 1), ("B", 1)]
    assert sorted(map(tuple, clean.collect())) == [("A", 2), ("B", 1)]


def test_join_needs_a_shared_column(spark, sales):
    other = spark.createDataFrame([(1,)], "other int")
    with pytest.raises(ValueError, match="no shared column"):
        tf.join_tables({"s": sales, "o": other}, "s", ["o"], "left join")
    assert tf.guess_join_key(["x", "b", "a"], ["a", "b"]) == "a"
    assert tf.guess_join_key(["x", "b", "a"], ["a", "b"], scan="base") == "b"


@pytest.mark.parametrize(
    "spec,message",
    [
        ({"viz": "radar"}, "unknown chart"),
        ({"viz": "pie", "dimensions": ["region"], "metrics": []}, "1-1 metrics"),
        ({"viz": "kpi", "dimensions": ["region"], "metrics": [{"agg": "COUNT"}]}, "0-0 dimensions"),
        ({"viz": "bar", "dimensions": ["region", "n", "code"], "metrics": [{"agg": "COUNT"}]}, "1-2 dimensions"),
        ({"dimensions": ["ghost"]}, "not a column"),
        ({"metrics": [{"col": "price", "agg": "MODE"}]}, "unknown aggregate"),
        ({"metrics": [{"agg": "SUM"}]}, "needs a column"),
        ({"filters": [{"col": "n", "op": "~"}]}, "unknown filter"),
        ({"filters": [{"col": "n", "op": ">"}]}, "needs a value"),
    ],
)
def test_spec_errors(sales, spec, message):
    with pytest.raises(an.SpecError, match=message):
        an.analyze(sales, spec)


def test_limits_and_order(sales):
    assert [an.row_limit(x) for x in (0, None, 7, 1000)] == [100, 100, 7, 1000]
    with pytest.raises(an.SpecError, match="between 1 and 1000"):
        an.row_limit(5000)
    out = an.analyze(sales, {"dimensions": ["region"], "metrics": [{"col": "price", "agg": "SUM"}], "limit": 2})
    assert [tuple(r) for r in out.collect()] == [("a", 30.0), ("b", 12.0)]
    assert an.analyze(sales, {"dimensions": ["n"], "limit": 3}).count() == 3
    assert an.metric_label("Price sum", "SUM") == "Price sum" and an.metric_label("Price", "MAX") == "Price max"
    assert an.metric_label("Discount", "COUNT") == "Discount count" and an.metric_label("Users distinct count", "COUNT_DISTINCT") == "Users distinct count"


def test_median_per_group(sales):
    out = an.analyze(sales, {"dimensions": ["region"], "metrics": [{"col": "price", "agg": "median", "name": "m"}]})
    assert {r.region: r.m for r in out.collect()} == {"a": 15.0, "b": 6.0, "c": None}


def test_column_roles(spark):
    schema = spark.createDataFrame([], "a string, t timestamp, d date, n decimal(5,1), i int").schema
    roles = an.column_roles(schema, documented=["i", "gone"], labels={"a": "Name"})
    assert [r["name"] for r in roles] == ["i", "a", "t", "d", "n"]
    assert {r["name"]: r["role"] for r in roles} == {"a": "dimension", "t": "time", "d": "time", "n": "measure", "i": "measure"}
    assert roles[1]["label"] == "Name"


def test_half_up_and_percent(spark):
    row = spark.range(1).select(
        numbers.half_up(F.lit(2.675), 2).alias("a"), numbers.percent(F.lit(0), F.lit(0)).alias("b"),
        numbers.percent(F.lit(1), F.lit(3)).alias("c"), numbers.percent(F.lit(0), F.lit(0), empty=0.0).alias("d"),
        times.temporal_text(F.lit(1704067200000), "DATE", "Asia/Seoul").alias("e"),
        times.temporal_text(F.lit(1704067200000), "TIMESTAMP", "Asia/Seoul").alias("f"),
        times.temporal_text(F.lit("n/a"), "DATE", "UTC").alias("g"),
    ).head()
    assert tuple(row) == (2.68, None, 33.3, 0.0, "2024-01-01", "2024-01-01 09:00:00", "n/a")


# ---------------------------------------------------------------- text functions


def fnv(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    return h


def test_fnv_counts_utf16_units(spark):
    words = ["", "a", "G:not_null|error", "한글 · é", "😀x"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert {r.s: r.h for r in df.select("s", texts.fnv1a32(F.col("s")).alias("h")).collect()} == {w: fnv(w) for w in words}


def test_condition_round_trip(spark):
    df = spark.createDataFrame([({"min_value": ["0"], "values": list("abcdefgh")},), ({},), (None,)], "kw map<string,array<string>>")
    got = [r.c for r in df.select(texts.condition_text(F.lit("range"), F.col("kw")).alias("c")).collect()]
    assert got[1:] == ["range", "range"]
    parsed = spark.createDataFrame([(got[0],), ("plain",), ("x (a=1 · b= c=d )",), ("open (a=1",)], "c string")
    maps = [r.m for r in parsed.select(texts.parse_condition(F.col("c")).alias("m")).collect()]
    assert maps == [{"min_value": "0", "values": "a, b, c, d, e, f"}, {}, {"a": "1", "b": "c=d"}, {}]


def test_object_keys(spark):
    paths = ["analytics/t/data/x.parquet", "analytics/t/metadata/v1.json", "ducklake/analytics/t__dbt_tmp/x.parquet",
             "top.txt", "a/b", "ducklake/a/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(texts.object_key(F.col("p")).alias("k"))
    assert [tuple(r.k) if r.k else None for r in df.collect()] == [
        ("analytics", "t", "data"), ("analytics", "t", "metadata"), ("analytics", "t", "data"), None, None, None]


def test_sql_audit(spark):
    rows = [
        (1, "select 1 from {{ ref('a') }}"), (2, "select 1; select 2"), (3, "create table t as select 1"),
        (4, "select ';drop table x' -- ; truncate table y\n from {{ ref('a') }}"), (5, "with q as (select 1), r as (select 2) select * from q"),
        (6, "{% set x = 1 %} values (1)"), (7, "select 'it''s; fine' from {{ ref('zz') }} join {{ source('s','t') }} /* {{ ref('no') }} */"),
    ]
    got = {r.id: r for r in sqltexts.audit_sql(spark.createDataFrame(rows, "id int, sql string"),
                                               spark.createDataFrame([("a",)], "id string")).collect()}
    assert [i for i in got if got[i].ok] == [i for i in got if i in (1, 4, 5)]
    assert got[2].statements == 2 and got[3].ddl == "create table" and got[5].ctes == 2 and got[6].selects == 0
    assert got[7].missing == ["zz"] and got[7].statements == 1
    more = [(1, "Create OR replace View v as select 1"), (2, "update t set a = 1"), (3, "grant all on t to u; ;"), (4, "select '-- ' || 'a;b' -- x"),
            (5, "select a from created"), (6, ""), (7, None), (8, "with a as (delete from t),b as (select 1) select 2")]
    scan = {r.id: r for r in sqltexts.audit_sql(spark.createDataFrame(more, "id int, sql string"),
                                                spark.createDataFrame([], "id string")).collect()}
    assert [scan[i].ddl for i in range(1, 9)] == ["Create OR replace View", "update t set", "grant", None, None, None, None, "delete from"]
    assert [scan[i].statements for i in range(1, 7)] == [1, 1, 1, 1, 1, 0] and scan[8].ctes == 2 and scan[8].selects == 2
    refs = sqltexts.extract_refs(spark.createDataFrame(rows, "id int, sql string"))
    assert sorted((r.id, r.kind, r.target) for r in refs.collect()) == [
        (1, "ref", "a"), (4, "ref", "a"), (7, "ref", "zz"), (7, "source", "s.t")]


def test_node_states(spark):
    rows = [("error", "success", False, "err"), ("skipped", None, False, "skip"), ("success", None, True, "err"),
            ("pass", None, False, "ok"), (None, "upstream_failed", False, "skip"), (None, "queued", False, "wait"),
            (None, "up_for_retry", False, "run"), (None, None, False, "wait")]
    df = spark.createDataFrame(rows, "b string, t string, f boolean, want string")
    out = df.select(status.node_state(F.col("b"), F.col("t"), F.col("f")).alias("got"), "want",
                    status.run_state(F.lit("queued")).alias("r"))
    assert all(r.got == r.want and r.r == "run" for r in out.collect())


# ---------------------------------------------------------------- quality


def test_nulls_do_not_fail_value_checks(sales):
    assert quality.accepted_range(sales, "price", 6, 15).count() == 2
    assert quality.accepted_values(sales, "code", ["x", "y"]).count() == 1
    assert quality.accepted_values(sales, "code", ["x", "y", None]).count() == 1
    assert quality.unique(sales, "code").count() == 2
    assert quality.relationships(sales, "code", sales.filter("code = 'x'"), "code").count() == 3
    assert quality.freshness(sales.withColumn("t", F.lit(None).cast("string")), "t", max_age_hours=1, as_of="2024-01-01").count() == 1


def test_run_rules_scopes(sales):
    rules = [{"id": "r1", "model": "s", "check": "not_null", "col": "code"},
             {"id": "r2", "model": "s", "check": "unique", "col": "code", "severity": "warn"},
             {"id": "r3", "model": "s", "check": "not_null", "col": "n", "enabled": False}]
    got = {r.rule_id: (r.status, r.failures) for r in quality.run_rules({"s": sales}, rules).collect()}
    assert got == {"r1": ("err", 1), "r2": ("warn", 2), "r3": ("unknown", None)}
    values = quality.run_rules({"s": sales}, rules, scope="r2", count="values")
    assert {r.rule_id: r.failures for r in values.collect()}["r2"] == 1
    with pytest.raises(KeyError):
        quality.rules_in_scope(rules, "ghost")


STATE = "rule_id string, uid string, type string, dimension string, model_id string, col string, cond string, sev string, active boolean, singular boolean, status string, cnt long"


def test_scores_and_groups(spark):
    rows = [
        ("a", "a", "notnull", "completeness", "m1", "c", "not_null", "error", True, False, "ok", 0),
        ("b", "b", "notnull", "completeness", "m2", "c", "not_null", "error", True, False, "err", 3),
        ("c", "c", "unique", "uniqueness", "m2", "c", "unique", "warn", True, False, "unknown", 0),
        ("d", "d", "sql", "custom", "m3", "", "singular", "error", False, True, "unknown", 0),
    ]
    state = spark.createDataFrame(rows, STATE).withColumn("cond_all", F.col("cond"))
    d = quality.dashboard(state).head()
    assert (d.rule_total, d.measured, d.passed, d.err_rows, d.not_run_count, d.affected_models, d.score) == (3, 2, 1, 3, 1, 1, 50.0)
    assert quality.dashboard(state.filter("status = 'unknown'")).head().score is None
    groups = {r.key: (r.status, r.models, r.score) for r in quality.group_rules(state).collect()}
    assert groups == {"G:not_null|error": ("err", 2, 50.0), "G:unique|warn": ("notrun", 1, None), "S:d": ("off", 1, None)}
    assert {r.model_id: (r.completeness, r.uniqueness, r.overall) for r in quality.quality_matrix(state).collect()} == {
        "m1": (100.0, None, 100.0), "m2": (0.0, None, 0.0)}
    assert quality.rule_filters(state, page=2, page_size=3).count() == 1
    groups, members = quality.group_rules(state), quality.group_members(state)
    keys = lambda **asked: sorted(r.key for r in quality.group_filters(groups, members, **asked).collect())
    assert keys(status="err") == ["G:not_null|error"] and keys(status="ok") == []
    assert keys(model="m2") == ["G:not_null|error", "G:unique|warn"] and keys(model="m2", dimension="uniqueness") == ["G:unique|warn"]
    assert keys(search="M3") == ["S:d"] and keys(search="unique") == ["G:unique|warn"] and len(keys(page=2, page_size=2)) == 1


def test_rules_that_differ_in_a_seventh_value_are_two_groups(spark):
    args = spark.createDataFrame([(1, list("abcdefg")), (2, list("abcdefh")), (3, list("abcdefg"))], "n int, v array<string>")
    text = args.select("n", F.create_map(F.lit("values"), F.col("v")).alias("args")).select(
        "n", texts.condition_text(F.lit("accepted"), F.col("args")).alias("cond"),
        texts.condition_text(F.lit("accepted"), F.col("args"), shown=None).alias("cond_all"))
    state = text.select(
        F.concat(F.lit("r"), "n").alias("rule_id"), F.lit("accepted").alias("type"), F.lit("m").alias("model_id"), "cond", "cond_all",
        F.lit("error").alias("sev"), F.lit(True).alias("active"), F.lit(False).alias("singular"), F.lit("ok").alias("status"), F.lit(0).alias("cnt"))
    got = {(r.cond, r.targets) for r in quality.group_rules(state).collect()}
    assert got == {("accepted (values=a, b, c, d, e, f)", 1), ("accepted (values=a, b, c, d, e, f)", 2)}


def test_report_is_exported_with_headings_and_bom(spark):
    row = ("r", "u", "notnull", "completeness", "m", None, 'a "b", c', "error", True, False, "ok", 0)
    path = fresh_path(spark, "report")
    quality.export_report(spark.createDataFrame([row], STATE), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].lstrip("\ufeff") == ",".join(quality.REPORT_HEADINGS.values())
    assert lines[1].startswith("r,m,") and lines[1].endswith(',error,ok,0,"a ""b"", c"')


def test_merged_histories_need_no_column_of_their_own(spark):
    tests = spark.createDataFrame(
        [(f"t{k % 2}", f"u{k % 2}", "2024-01-30 10:00:00", "pass", k) for k in range(8)],
        "test_name string, test_unique_id string, detected_at string, status string, run int")
    members = spark.createDataFrame([("t0",)], "rule_id string")
    few = quality.merge_histories(tests, members, days=7, as_of="2024-01-31", tie="run", limit=2).collect()
    assert sorted(r.run for r in few) == [4, 6]
    assert quality.merge_histories(tests, members, days=7, as_of="2024-01-31", tie="run", limit=None).count() == 4


# ---------------------------------------------------------------- lineage


def brute_owner(models, edges, flows, targets):
    up = {}
    for s, d in edges:
        up.setdefault(d, []).append(s)
    owner = {}
    for fid, at, seeds in sorted(flows, key=lambda f: (f[1], f[0])):
        mine = [t for f, t in targets if f == fid]
        stop = {m for m, o in owner.items() if o != fid} - set(mine)
        seen, todo = set(), list(mine)
        while todo:
            m = todo.pop()
            if m in seen:
                continue
            seen.add(m)
            if m not in stop:
                todo += up.get(m, [])
        for m in seen - stop:
            if models[m] == "model" or (models[m] == "seed" and seeds):
                owner.setdefault(m, fid)
    return owner


@pytest.mark.parametrize("seed", range(3))
def test_ownership_equals_flow_by_flow_walk(spark, seed):
    rng = random.Random(seed)
    ids = [f"m{i:02d}" for i in range(40)]
    models = {m: "model" if i > 9 else rng.choice(["seed", "source"]) for i, m in enumerate(ids)}
    edges = sorted({(ids[a], ids[b]) for a, b in ((rng.randrange(39), rng.randrange(10, 40)) for _ in range(70)) if a < b})
    flows = [(f"f{i}", float(rng.randrange(4)), bool(rng.randrange(2))) for i in range(8)]
    targets = sorted({(f"f{rng.randrange(8)}", rng.choice(ids)) for _ in range(14)})
    got = lineage.ownership(
        spark.createDataFrame(list(models.items()), "id string, dbt_type string"),
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(flows, "id string, created_at double, include_seeds boolean"),
        spark.createDataFrame(targets, "flow string, id string"),
    )
    assert {r.id: r.owner for r in got.collect()} == brute_owner(models, edges, flows, targets)


def test_flow_with_seeds_and_stop(spark):
    models = spark.createDataFrame(
        [("x", "seed"), ("s", "source"), ("a", "model"), ("b", "model"), ("c", "model")], "id string, dbt_type string")
    edges = spark.createDataFrame([("x", "a"), ("s", "a"), ("a", "b"), ("b", "c"), ("ghost", "c")], "src string, dst string")
    nodes = {r.id: r for r in lineage.flow_nodes(models, edges, ["c", "nope"], include_seeds=True).collect()}
    assert {k: (v.depth, v.seq) for k, v in nodes.items()} == {"x": (0, 1), "s": (0, None), "a": (1, 2), "b": (2, 3), "c": (3, 4)}
    stop = spark.createDataFrame([("b",), ("c",)], "id string")
    cut = lineage.flow_nodes(models, edges, ["c"], stop=stop)
    assert {r.id: (r.read_only, r.executable, r.depth) for r in cut.collect()} == {"b": (True, False, 0), "c": (False, True, 1)}
    tasks = lineage.task_graph(cut, edges)
    assert [tuple(r) for r in tasks.collect()] == [("c", "_done")]
    assert [r.id for r in lineage.missing_targets(models, ["c", "nope"]).collect()] == ["nope"]


def test_staleness_looks_past_the_nearest_level(spark):
    edges = spark.createDataFrame([("raw", "mid"), ("mid", "mart"), ("u", "other")], "src string, dst string")
    loads_ = spark.createDataFrame([("raw", 9), ("mid", 2), ("mart", 5), ("u", None), ("other", 1)], "id string, loaded_at int")
    got = {r.id: (r.upstream_load, r.stale) for r in lineage.staleness(edges, loads_).collect()}
    assert got == {"raw": (None, False), "mid": (9, True), "mart": (9, True), "u": (None, False), "other": (None, False)}


def test_edge_check_order(spark):
    models = spark.createDataFrame([("s", "source"), ("a", "model"), ("b", "model"), ("c", "model")], "id string, dbt_type string")
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "c")], "src string, dst string")
    proposed = spark.createDataFrame([("a", "s"), ("a", "b"), ("c", "a"), ("a", "a"), ("a", "c")], "src string, dst string")
    got = {(r.src, r.dst): r.verdict for r in lineage.edge_check(models, edges, proposed).collect()}
    assert got == {("a", "s"): "source_input", ("a", "b"): "duplicate", ("c", "a"): "cycle", ("a", "a"): "cycle", ("a", "c"): "ok"}


def test_updated_inputs_any_not_all(spark):
    watched = spark.createDataFrame([("f", "a", "read_only"), ("f", "b", "seed"), ("g", "src", "source"), ("h", "fed", "source")],
                                    "flow string, input_id string, input_kind string")
    events = spark.createDataFrame([("a", 5), ("b", 1), ("src", 9), ("fed", 9)], "input_id string, at int")
    runs = spark.createDataFrame([("f", 3), ("g", 1)], "flow string, at int")
    loaded = spark.createDataFrame([("fed",)], "target string")
    assert sorted(r.flow for r in lineage.updated_inputs(watched, events, runs, loaded).collect()) == ["f", "h"]


# ---------------------------------------------------------------- history, storage, catalog


def test_merged_spans_equal_separate_spans(spark):
    rng = random.Random(5)
    stamp = lambda: f"2024-01-{rng.randrange(20, 31):02d} {rng.randrange(24):02d}:00:00"
    results = spark.createDataFrame(
        [(f"i{rng.randrange(9)}", f"m{rng.randrange(6)}", rng.choice(["model", "test"]), rng.choice(["success", "error", "pass", "warn"]),
          rng.randrange(1000) / 10, stamp()) for _ in range(200)],
        "invocation_id string, name string, resource_type string, status string, execution_time double, generated_at string")
    inv = spark.createDataFrame([(f"i{i}", "build", stamp(), stamp()) for i in range(9)],
                                "invocation_id string, command string, run_started_at string, run_completed_at string")
    checks = history.spans_agree(inv, results, as_of="2024-01-31 00:00:00").collect()
    assert len(checks) == 4 and all(c.ok and c.compared for c in checks)
    with pytest.raises(ValueError):
        history.summary(inv, results, days=0, as_of=None)


def test_storage_never_built_and_other(spark):
    objects = spark.createDataFrame([("a/t/data/x", 10), ("a/t/metadata/y", 2), ("a/t__tmp_1/data/x", 4), ("w/r/data/x", 8), ("z.txt", 1)], "path string, length long")
    models = spark.createDataFrame([("a.t",), ("a.never",)], "phys string")
    live = spark.createDataFrame([("a.t", 7), ("a.never", 3)], "phys string, bytes long")
    tables = storage.stale_bytes(objects, models, live, observed=["w"])
    got = {r.phys: (r.kind, r.bytes, r.live_bytes, r.stale_bytes) for r in tables.collect()}
    assert got == {"a.t": ("catalog", 12, 7, 5), "a.never": ("catalog", 0, None, None), "a.t__tmp_1": ("temp", 4, None, None), "w.r": ("observability", 8, None, None)}
    shares = storage.schema_share_with_other(storage.by_schema(tables), objects)
    assert {r.schema: r.bytes for r in shares.collect()} == {"a": 16, "other": 9}


def test_usage_counts_zero_fill(spark):
    items = spark.createDataFrame([("x",), ("x",)], "g string")
    groups = spark.createDataFrame([("x",), ("y",)], "id string")
    assert {r.id: r["items"] for r in catalog.usage_counts(items, "g", groups, "id").collect()} == {"x": 2, "y": 0}


# ---------------------------------------------------------------- streaming


def test_stream_resumes_where_it_stopped(spark):
    landing, root, mark = (fresh_path(spark, p) for p in ("l", "r", "m"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    df.coalesce(1).write.parquet(landing)
    run = lambda: loads.incremental_stream_load(
        loads.file_stream(spark, landing, df.schema, files_per_step=1), root, ingested_at="t", checkpoint=mark,
        on_update=lambda step, n: woken.append(n))
    woken = []
    assert run() == 2 and woken == [2]
    assert run() == 0 and woken == [2]
    df.limit(0).coalesce(1).write.mode("append").parquet(landing)
    assert run() == 0 and woken == [2]
    df.filter("id = 1").coalesce(1).write.mode("append").parquet(landing)
    assert run() == 1 and woken == [2, 1]
    assert loads.loaded_rows(spark, root).count() == 3


def test_lost_checkpoint_loads_no_file_twice(spark):
    landing, root = fresh_path(spark, "l"), fresh_path(spark, "r")
    df = spark.createDataFrame([(k, "a") for k in range(6)], "id int, v string")
    run = lambda: loads.incremental_stream_load(
        loads.file_stream(spark, landing, df.schema, files_per_step=1), root, ingested_at="t")
    df.filter("id < 4").repartition(2).write.parquet(landing)
    assert run() == 4
    df.filter("id >= 4").coalesce(1).write.mode("append").parquet(landing)
    assert run() == 2 and run() == 0  # every run starts at step 0 of a new checkpoint
    assert sorted(int(r.id) for r in loads.loaded_rows(spark, root).collect()) == list(range(6))


def test_uncommitted_step_is_not_read(spark):
    landing, root = fresh_path(spark, "l"), fresh_path(spark, "r")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    df.coalesce(1).write.parquet(landing)
    stream = loads.file_stream(spark, landing, df.schema)
    loads.incremental_stream_load(stream, root, ingested_at="t")
    spark.read.parquet(f"{root}/rows").drop("load").write.parquet(f"{root}/rows/load=00000009-dead")
    assert loads.loaded_rows(spark, root).count() == 1


def test_event_log_raises_what_is_not_a_missing_log(spark):
    root = fresh_path(spark, "log")
    event = spark.createDataFrame([("s", 0, 3)], "source string, step long, rows long")
    for _ in range(2):
        loads.event_log(spark, root, event)
    assert spark.read.parquet(root).count() == 1
    spark.createDataFrame([("x",)], "source string").write.mode("overwrite").text(root)
    with pytest.raises(Exception):  # noqa: B017 - a damaged log must not read as an empty one
        loads.event_log(spark, root, event)


def _seen(spark, rows):
    return spark.createDataFrame(rows, "id string, at string, tick long, state string").select(
        "id", F.col("at").cast("timestamp").alias("seen_at"), "tick", "state")


def test_status_change_stream_equals_the_batch_on_late_arrivals(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(4)}", f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00.{rng.randrange(10**6):06d}", k, rng.choice(["run", "ok", None]))
            for k in range(120)]
    rows += [("hot", "2024-01-03 01:00:00", k, "ok" if k % 50 else "err") for k in range(200)] + [("one", "2024-01-01 00:00:00", 0, None)]
    landing, root, mark = (fresh_path(spark, p) for p in ("l", "r", "m"))
    shuffled = rng.sample(rows, len(rows))
    for k in range(4):
        _seen(spark, shuffled[k::4]).write.mode("append").parquet(landing)
        stream = loads.file_stream(spark, landing, _seen(spark, []).schema)
        changes.status_change_stream(stream, root, delay="30 days", checkpoint=mark)
    assert changes.emitted_changes(spark, root).count() == 0  # all may still be preceded by earlier ones
    changes.close(spark, landing, "2025-01-01")
    changes.status_change_stream(stream, root, delay="30 days", checkpoint=mark)
    key = lambda r: (r.id, r.seen_at, r.tick, str(r.state))
    want = changes.status_changes(_seen(spark, rows)).collect()
    assert sorted(map(key, changes.emitted_changes(spark, root).collect())) == sorted(map(key, want))


def test_status_change_stream_settles_by_the_watermark(spark):
    landing, root, mark = (fresh_path(spark, p) for p in ("l", "r", "m"))
    stream = lambda: loads.file_stream(spark, landing, _seen(spark, []).schema)
    for rows in (
        [("n", "2024-01-01 00:00:00", 1, "wait"), ("n", "2024-01-01 02:00:00", 3, "ok")],
        [("n", "2024-01-01 01:00:00", 2, "run"), ("k", "2024-01-03 00:00:00", 4, "ok")],
    ):
        _seen(spark, rows).write.mode("append").parquet(landing)
        changes.status_change_stream(stream(), root, delay="1 day", checkpoint=mark)
    got = [(r.id, r.tick, r.state) for r in changes.emitted_changes(spark, root).collect()]
    assert sorted(got) == [("n", 1, "wait"), ("n", 2, "run"), ("n", 3, "ok")]  # "k" is still within the delay


def test_late_rows_go_to_the_side_table(spark):
    landing, root, mark = (fresh_path(spark, p) for p in ("l", "r", "m"))
    make = lambda rows: spark.createDataFrame(rows, "t string, v int").select(F.col("t").cast("timestamp").alias("t"), "v")
    stream = lambda: loads.file_stream(spark, landing, make([]).schema)
    go = lambda m: loads.daily_stream(stream(), "t", root, measures={"n": F.count(F.lit(1)), "v": F.sum("v")}, delay="6 hours", checkpoint=m)
    make([("2024-01-01 10:00:00", 1), ("2024-01-02 05:00:00", 2)]).coalesce(1).write.parquet(landing)
    go(mark)
    assert loads.closed_days(spark, root, delay="6 hours").count() == 0
    make([("2024-01-01 11:00:00", 4), ("2024-01-02 07:00:00", 8)]).coalesce(1).write.mode("append").parquet(landing)
    go(mark)  # in time: the day was open when the step began
    make([("2024-01-01 12:00:00", 16), (None, 32)]).coalesce(1).write.mode("append").parquet(landing)
    go(mark)
    go(None)  # a new checkpoint reads everything again
    closed = [(r.date, r.n, r.v) for r in loads.closed_days(spark, root, delay="6 hours").collect()]
    assert closed == [("2024-01-01", 2, 5)]
    assert sorted(r.v for r in loads.late_rows(spark, root).collect()) == [16, 32]


def test_objects_are_listed_by_folder(spark):
    root = fresh_path(spark, "objects")
    assert listing.list_objects(spark, root).count() == 0
    spark.range(20).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b")).repartition(1).write.partitionBy("a", "b").parquet(root)
    for width in (1, 2, 5, 100):
        found = listing.list_objects(spark, root, width=width)
        seen = found.filter(~listing.hidden(F.col("path"))).withColumn("folder", listing.folder_under(F.col("path"), root)).collect()
        assert sorted(r.folder for r in seen) == sorted(f"a={a}/b={b}" for a in range(3) for b in range(2))
        assert all(r.bytes > 0 and r.modified is not None for r in seen)
    paths = ["/x/_SUCCESS", "/x/.a.crc", "/x/_tmp/f", "/x/_day=1/f", "/x/f"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(listing.hidden(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_daily_window_cuts_at_local_midnight(spark):
    df = spark.createDataFrame([("2024-01-01 14:59:59",), ("2024-01-01 15:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    out = loads.daily_tumbling(df, "t", tz="Asia/Seoul").collect()
    assert sorted((r.date, r.n) for r in out) == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_only_undecided_proposals_are_walked(spark, monkeypatch):
    models = spark.createDataFrame([("s", "source"), *[(k, "model") for k in "abc"]], "id string, dbt_type string")
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "c")], "src string, dst string")
    proposed = spark.createDataFrame(
        [("c", "a"), ("a", "b"), ("b", "s"), ("b", "b"), ("a", "c"), (None, "c")], "src string, dst string"
    )
    walked, closure = [], lineage.reach.closure

    def seen(steps, start, **kw):
        walked.extend(r.root for r in start.collect())
        return closure(steps, start, **kw)

    monkeypatch.setattr(lineage.reach, "closure", seen)
    got = {(r.src, r.dst): r.verdict for r in lineage.edge_check(models, edges, proposed).collect()}
    assert got == {
        ("c", "a"): "cycle", ("a", "b"): "duplicate", ("b", "s"): "source_input", ("b", "b"): "cycle",
        ("a", "c"): "ok", (None, "c"): "ok",
    }
    assert sorted(walked) == ["a", "c"]
