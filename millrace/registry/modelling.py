"""Transforms and analyses over orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import texts, times
from millrace.functions.numbers import half_up
from millrace.operators import analyze as an
from millrace.operators import transform as tf
from millrace.registry.book import book
from millrace.registry.facts import table


def _tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names}


def _shop(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Orders and customers sharing the key name ``custkey``."""
    t = _tables(spark, sf, "orders", "customer")
    return {
        "orders": t["orders"].withColumnRenamed("o_custkey", "custkey"),
        "customer": t["customer"].withColumnRenamed("c_custkey", "custkey"),
    }


@book.entry("pick_columns", "SELECT c_name, c_custkey FROM customer")
def pick(spark: SparkSession, sf: str) -> DataFrame:
    form = tf.Form(base="customer", cols=["c_name", "no_such_column", "c_custkey"])
    return tf.transform(_tables(spark, sf, "customer"), form)


@book.entry("clean_trim", "SELECT s_suppkey, trim(' ' || s_name || '  ') AS s_name FROM supplier")
def clean_trim(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("s_name")
    )
    return tf.transform({"s": padded}, tf.Form(base="s", clean=["trim"]))


@book.entry("clean_upper", "SELECT p_partkey, upper(trim(p_name)) AS p_name FROM part")
def clean_upper(spark: SparkSession, sf: str) -> DataFrame:
    form = tf.Form(base="part", cols=["p_partkey", "p_name"], clean=["trim", "upper"])
    return tf.transform(_tables(spark, sf, "part"), form)


@book.entry(
    "drop_missing_required",
    """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NOT NULL""",
)
def drop_missing(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf, "documents", "labels")
    joined = t["documents"].join(t["labels"], "doc_id", "left").select("doc_id", "lang", "quality")
    return tf.transform({"d": joined}, tf.Form(base="d", clean=["required"]), required=["quality"])


@book.entry(
    "filter_expr",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE (o_totalprice > 100000 OR o_orderpriority = '1-URGENT') AND o_orderstatus = 'F'""",
)
def filter_expr(spark: SparkSession, sf: str) -> DataFrame:
    form = tf.Form(
        base="orders", cols=["o_orderkey", "o_totalprice"],
        filter="(a.o_totalprice > 100000 or a.o_orderpriority = '1-URGENT') and a.o_orderstatus = 'F'",
    )
    return tf.transform(_tables(spark, sf, "orders"), form)


@book.entry(
    "clean_distinct",
    "SELECT DISTINCT upper(trim(o_orderstatus)) AS o_orderstatus, "
    "upper(trim(o_orderpriority)) AS o_orderpriority FROM orders",
)
def clean_distinct(spark: SparkSession, sf: str) -> DataFrame:
    form = tf.Form(
        base="orders", cols=["o_orderstatus", "o_orderpriority"], clean=["trim", "upper", "distinct"]
    )
    return tf.transform(_tables(spark, sf, "orders"), form)


for _how, _sql in (("left join", "LEFT"), ("inner join", "INNER"), ("full outer join", "FULL")):

    def _join(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        # The base is customers, so a customer with many orders fans out.
        form = tf.Form(
            base="customer", joins=["orders"], join_type=how, cols=["custkey", "c_mktsegment"]
        )
        return tf.transform(_shop(spark, sf), form)

    book.entry(
        f"transform_join_{_sql.lower()}",
        f"SELECT a.c_custkey AS custkey, a.c_mktsegment FROM customer a {_sql} JOIN orders b "
        "ON b.o_custkey = a.c_custkey",
    )(_join)


@book.entry(
    "guess_join_key",
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def guess_key(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    key = tf.guess_join_key(shop["orders"].columns, shop["customer"].columns)
    ui_key = tf.guess_join_key(shop["orders"].columns, shop["customer"].columns, scan="base")
    assert key == ui_key == "custkey"
    return shop["orders"].join(shop["customer"], key).select("o_orderkey", "c_name")


@book.entry(
    "join_on_expr",
    """SELECT b.c_nationkey AS nationkey, count(*) AS row_count FROM orders a
       JOIN customer b ON b.c_custkey = a.o_custkey AND b.c_acctbal * 40 < a.o_totalprice
       GROUP BY 1""",
)
def join_on_expr(spark: SparkSession, sf: str) -> DataFrame:
    joined = tf.join_tables(
        _tables(spark, sf, "orders", "customer"), "orders", ["customer"], "inner join",
        on="b.c_custkey = a.o_custkey and b.c_acctbal * 40 < a.o_totalprice",
    )
    return joined.groupBy(F.col("b.c_nationkey").alias("nationkey")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@book.entry(
    "form_aggregate_count",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS row_count FROM orders GROUP BY 1, 2",
)
def form_count(spark: SparkSession, sf: str) -> DataFrame:
    form = tf.Form(base="orders", agg="count", cols=["o_orderstatus", "o_orderpriority", "o_orderkey"])
    return tf.transform(_tables(spark, sf, "orders"), form)


for _fn in ("sum", "avg", "max", "min"):

    def _agg(spark: SparkSession, sf: str, fn: str = _fn) -> DataFrame:
        form = tf.Form(base="lineitem", agg=fn, agg_col="l_quantity", group_by=["l_returnflag", "l_linestatus"])
        out = tf.transform(_tables(spark, sf, "lineitem"), form)
        return out.withColumn(f"{fn}_l_quantity", half_up(F.col(f"{fn}_l_quantity"), 4))

    book.entry(
        f"form_aggregate_{_fn}",
        f"SELECT l_returnflag, l_linestatus, round({_fn}(l_quantity) + 1e-9, 4) AS {_fn}_l_quantity "
        "FROM lineitem GROUP BY 1, 2",
    )(_agg)


@book.entry(
    "form_aggregate_raw_key",
    """SELECT upper(k) AS seg, row_count FROM (
         SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS k,
                count(*) AS row_count FROM customer GROUP BY 1)""",
)
def form_raw_key(spark: SparkSession, sf: str) -> DataFrame:
    mixed = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment"))
        .otherwise(F.col("c_mktsegment")).alias("seg")
    )
    return tf.transform({"c": mixed}, tf.Form(base="c", agg="count", clean=["upper"]))


@book.entry(
    "ui_aggregate_model",
    "SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS total_value FROM customer GROUP BY 1, 2",
)
def ui_model(spark: SparkSession, sf: str) -> DataFrame:
    out = tf.ui_aggregate(
        _tables(spark, sf, "customer"), "customer", agg="sum",
        cols=["c_mktsegment", "c_nationkey", "c_acctbal"],
    )
    return out.withColumn("total_value", F.round("total_value", 2))


@book.entry(
    "ui_aggregate_quick",
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY 1",
)
def ui_quick(spark: SparkSession, sf: str) -> DataFrame:
    out = tf.ui_aggregate(
        _tables(spark, sf, "orders"), "orders", agg="sum", variant="quick",
        group_by=["o_orderstatus"], agg_col="o_totalprice",
    )
    return out.withColumn("total_amount", F.round("total_amount", 2))


def order_mart(spark: SparkSession, sf: str) -> DataFrame:
    """Orders enriched with their customer: the mart the analyses read."""
    t = _tables(spark, sf, "orders", "customer")
    return t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))


_MART = "orders JOIN customer ON o_custkey = c_custkey"


@book.entry(
    "analyze_segments",
    f"""SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue,
               round(median(o_totalprice) + 1e-9, 4) AS mid_price, count(*) AS orders,
               count(DISTINCT o_custkey) AS customers
        FROM {_MART} WHERE o_orderstatus != 'P' AND o_totalprice >= 1000 GROUP BY 1""",
)
def analyze_segments(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "viz": "table", "dimensions": ["c_mktsegment"], "limit": 5000,
        "metrics": [
            {"col": "o_totalprice", "agg": "SUM", "name": "revenue"},
            {"col": "o_totalprice", "agg": "MEDIAN", "name": "mid_price"},
            {"agg": "COUNT", "name": "orders"},
            {"col": "o_custkey", "agg": "COUNT_DISTINCT", "name": "customers"},
        ],
        "filters": [
            {"col": "o_orderstatus", "op": "!=", "val": "P"},
            {"col": "o_totalprice", "op": ">=", "val": 1000},
        ],
    }
    out = an.analyze(order_mart(spark, sf), spec, max_limit=10_000)
    return out.withColumn("revenue", F.round("revenue", 2)).withColumn(
        "mid_price", half_up(F.col("mid_price"), 4)
    )


@book.entry(
    "analyze_top_customers",
    f"""SELECT c_name, round(sum(o_totalprice), 2) AS revenue FROM {_MART}
        GROUP BY 1 ORDER BY sum(o_totalprice) DESC, c_name LIMIT 100""",
)
def analyze_top(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "viz": "bar", "dimensions": ["c_name"],
        "metrics": [{"col": "o_totalprice", "agg": "SUM", "name": "revenue"}], "limit": 0,
    }
    return an.analyze(order_mart(spark, sf), spec).withColumn("revenue", F.round("revenue", 2))


@book.entry("analyze_kpi", "SELECT round(median(l_extendedprice) + 1e-9, 4) AS mid FROM lineitem")
def analyze_kpi(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"viz": "kpi", "metrics": [{"col": "l_extendedprice", "agg": "MEDIAN", "name": "mid"}]}
    out = an.analyze(table(spark, sf, "lineitem"), spec)
    return out.withColumn("mid", half_up(F.col("mid"), 4))


@book.entry(
    "analyze_raw_rows",
    "SELECT c_name, c_nationkey FROM customer WHERE c_acctbal < -900 AND c_name LIKE 'Customer#%'",
)
def analyze_raw(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "viz": "table", "dimensions": ["c_name", "c_nationkey"], "limit": 1000,
        "filters": [
            {"col": "c_acctbal", "op": "<", "val": -900}, {"col": "c_name", "op": "like", "val": "Customer#%"},
        ],
    }
    return an.analyze(table(spark, sf, "customer"), spec)


@book.entry(
    "spec_filters",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NULL AND d.lang <> 'en' AND d.n_chars > 100 AND d.n_chars <= 5000
             AND d.source LIKE 'src1%' AND d.doc_id >= 0 AND d.n_chars < 4900""",
)
def spec_filters(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf, "documents", "labels")
    rows = t["documents"].join(t["labels"], "doc_id", "left")
    cond = an.spec_filters([
        {"col": "quality", "op": "is null"}, {"col": "lang", "op": "!=", "val": "en"},
        {"col": "n_chars", "op": ">", "val": 100}, {"col": "n_chars", "op": "<=", "val": 5000},
        {"col": "source", "op": "LIKE", "val": "src1%"}, {"col": "doc_id", "op": ">=", "val": 0},
        {"col": "n_chars", "op": "<", "val": 4900}, {"col": "", "op": "==", "val": 1},
    ])
    return rows.filter(cond).select("doc_id", "quality")


@book.entry(
    "spec_metrics",
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_quantity) + 1e-9, 4) AS mean,
              round(median(l_quantity) + 1e-9, 4) AS mid, min(l_quantity) AS low, max(l_quantity) AS high,
              count(l_quantity) AS n, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY 1""",
)
def spec_metrics(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "dimensions": ["l_returnflag"], "limit": 1000,
        "metrics": [
            {"col": "l_quantity", "agg": a, "name": n}
            for a, n in (("sum", "total"), ("avg", "mean"), ("median", "mid"), ("min", "low"),
                         ("max", "high"), ("count", "n"))
        ] + [{"col": "l_suppkey", "agg": "COUNT_DISTINCT", "name": "suppliers"}],
    }
    out = an.analyze(table(spark, sf, "lineitem"), spec)
    return (
        out.withColumn("total", F.round("total", 2))
        .withColumn("mean", half_up(F.col("mean"), 4))
        .withColumn("mid", half_up(F.col("mid"), 4))
    )


@book.entry(
    "saved_chart_query",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders WHERE o_totalprice > 5000 GROUP BY 1, 2""",
)
def saved_chart(spark: SparkSession, sf: str) -> DataFrame:
    params = {
        "x_axis": "o_orderpriority", "groupby": ["o_orderstatus"], "row_limit": 1000,
        "metrics": [
            {"agg": "COUNT", "name": "n"}, {"expr": "sum(o_totalprice)", "name": "total"},
        ],
        "adhoc_filters": [
            {"subject": "o_totalprice", "operator": ">", "comparator": 5000},
            {"subject": None, "operator": "==", "comparator": 1},
        ],
    }
    out = an.saved_chart_query(table(spark, sf, "orders"), params)
    return out.withColumn("total", F.round("total", 2))


@book.entry(
    "search_contains",
    """SELECT p_partkey, p_name FROM part
       WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""",
)
def search(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col("p_name"), F.col("p_brand"), F.col("p_type")]
    return table(spark, sf, "part").filter(texts.contains_any(" Brand#1 ", cols)).select("p_partkey", "p_name")


@book.entry(
    "search_any_cell",
    """SELECT c_custkey FROM customer
       WHERE contains(CAST(c_custkey AS VARCHAR), '77') OR contains(lower(c_name), '77')
          OR contains(lower(c_mktsegment), '77')""",
)
def search_cells(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")]
    return table(spark, sf, "customer").filter(texts.any_cell_contains("77", cols)).select("c_custkey")


@book.entry(
    "relabel_metrics",
    f"""SELECT c_mktsegment AS "Segment", round(sum(o_totalprice), 2) AS "Price sum",
              max(o_totalprice) AS "Price max" FROM {_MART} GROUP BY 1""",
)
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    labels = {"c_mktsegment": "Segment", "o_totalprice": "Price"}
    spec = {
        "viz": "bar", "dimensions": ["c_mktsegment"], "limit": 1000,
        "metrics": [{"col": "o_totalprice", "agg": "SUM"}, {"col": "o_totalprice", "agg": "MAX"}],
    }
    out = an.relabel(an.analyze(order_mart(spark, sf), spec, labels), labels)
    return out.withColumn("Price sum", F.round("Price sum", 2))


@book.entry(
    "format_temporal",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS as_date,
              strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS as_time FROM orders""",
)
def format_temporal(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        times.temporal_text(ms, "DATE", "Asia/Seoul").alias("as_date"),
        times.temporal_text(ms, "TIMESTAMP", "Asia/Seoul").alias("as_time"),
    )


@book.entry(
    "column_roles",
    """SELECT role, count(*) AS rows FROM (
         SELECT CASE WHEN regexp_matches(upper(t), 'INT|DEC|NUMER|DOUBLE|FLOAT|REAL') THEN 'measure'
                     WHEN regexp_matches(upper(t), 'DATE|TIME') THEN 'time' ELSE 'dimension' END AS role
         FROM (SELECT CASE event_type WHEN 'view' THEN 'bigint' WHEN 'click' THEN 'timestamp'
                      WHEN 'error' THEN 'decimal(18,2)' ELSE event_type END AS t FROM events))
       GROUP BY 1""",
)
def roles(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "view", "bigint").when(kind == "click", "timestamp").when(
        kind == "error", "decimal(18,2)"
    ).otherwise(kind)
    return table(spark, sf, "events").groupBy(an.column_role(named).alias("role")).agg(
        F.count(F.lit(1)).alias("rows")
    )
