"""Spec-driven analysis: dimensions, metrics, filters and a limit answered as one DataFrame.

A spec from the screen and the parameters of a stored chart are two spellings of one question. Both are read into an
``Ask`` of typed parts, each of which knows its own column; one planner turns an ``Ask`` into a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import percentiles
from millrace.plans.percentiles import Quantile


class SpecError(ValueError):
    """The spec does not fit the model or the chart kind."""


@dataclass(frozen=True)
class Aggregate:
    """What a metric computes: its word in a label, and its Spark function (None: the exact median)."""

    word: str
    column: Callable[[Column], Column] | None


# Aggregates, comparisons, and how many (dimensions, metrics) a chart kind takes.
AGGREGATES = {
    "SUM": Aggregate("sum", F.sum),
    "AVG": Aggregate("average", F.avg),
    "MEDIAN": Aggregate("median", None),
    "MIN": Aggregate("min", F.min),
    "MAX": Aggregate("max", F.max),
    "COUNT": Aggregate("count", F.count),
    "COUNT_DISTINCT": Aggregate("distinct count", F.count_distinct),
}
COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__,
    "<=": Column.__le__, "LIKE": Column.like,
}
PRESENCE: dict[str, Callable[[Column], Column]] = {"IS NULL": Column.isNull, "IS NOT NULL": Column.isNotNull}
# Per chart the least and the largest number of dimensions, then of metrics.
CHARTS = {
    "table": ((0, 8), (0, 8)),
    "bar": ((1, 2), (1, 4)),
    "line": ((1, 2), (1, 4)),
    "pie": ((1, 1), (1, 1)),
    "kpi": ((0, 0), (1, 1)),
}
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Any = None

    @property
    def condition(self) -> Column:
        """LIKE patterns are used as given."""
        if test := PRESENCE.get(self.operator):
            return test(F.col(self.column))
        if self.operator not in COMPARISONS:
            raise SpecError(f"unknown filter operator {self.operator}")
        if self.value in (None, ""):
            raise SpecError(f"filter on {self.column} needs a value")
        return COMPARISONS[self.operator](F.col(self.column), self.value)


@dataclass(frozen=True)
class Metric:
    name: str
    aggregate: Aggregate
    column: str | None = None
    expression: str | None = None

    @classmethod
    def of(cls, given: Mapping[str, Any], labels: Mapping[str, str]) -> Metric:
        key, column = str(given.get("agg") or "SUM").upper(), given.get("col") or None
        counts_rows = key == "COUNT" and column is None
        if key not in AGGREGATES:
            raise SpecError(f"unknown aggregate {key}")
        if not (column or counts_rows or given.get("expr")):
            raise SpecError("the metric needs a column")
        aggregate = AGGREGATES[key]
        shown = aggregate.word if column is None else metric_label(labels.get(column) or column, key)
        return cls(str(given.get("name") or shown), aggregate, column, given.get("expr") or None)

    @property
    def median(self) -> Quantile | None:
        exact = self.aggregate.column is None and not self.expression
        return Quantile(self.name, F.col(self.column), 0.5) if exact else None

    @property
    def plain(self) -> Column:
        if self.expression:
            return F.expr(self.expression).alias(self.name)
        return self.aggregate.column(F.col(self.column) if self.column else F.lit(1)).alias(self.name)


@dataclass(frozen=True)
class Ask:
    """A question: what to group by, what to measure, which rows, how many of the answer."""

    dimensions: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    predicates: tuple[Predicate, ...] = field(default=())
    limit: int = DEFAULT_LIMIT

    @classmethod
    def of_spec(cls, spec: Mapping[str, Any], labels: Mapping[str, str] | None, max_limit: int) -> Ask:
        return cls(
            tuple(filter(None, spec.get("dimensions") or ())),
            tuple(Metric.of(m, labels or {}) for m in spec.get("metrics") or ()),
            _predicates(spec.get("filters"), "col", "op", "val"),
            row_limit(spec.get("limit"), max_limit),
        )

    @classmethod
    def of_chart(cls, stored: Mapping[str, Any]) -> Ask:
        """Stored charts name an axis apart from further groupings, and one metric or several; without either
        they show their raw columns."""
        lone = [stored["metric"]] if stored.get("metric") else []
        axis = [stored["x_axis"]] if stored.get("x_axis") else []
        metrics = tuple(Metric.of(m, {}) for m in stored.get("metrics") or lone)
        grouped = (*axis, *(stored.get("groupby") or ()))
        complete = [f for f in stored.get("adhoc_filters") or () if f.get("operator")]
        return cls(
            grouped if grouped or metrics else tuple(stored.get("all_columns") or ()), metrics,
            _predicates(complete, "subject", "operator", "comparator"), int(stored.get("row_limit") or DEFAULT_LIMIT),
        )

    def fit(self, kind: str, columns: Sequence[str]) -> Ask:
        """Itself, if the chart kind takes it and the model has its columns."""
        if kind not in CHARTS:
            raise SpecError(f"unknown chart kind {kind}")
        used = {*self.dimensions, *(m.column for m in self.metrics if m.column)}
        if missing := sorted(used.difference(columns)):
            raise SpecError(f"{', '.join(missing)} is not a column of this model")
        for what, parts, room in zip(("dimensions", "metrics"), (self.dimensions, self.metrics), CHARTS[kind]):
            least, most = room
            if not least <= len(parts) <= most:
                raise SpecError(f"{kind} takes {least}-{most} {what}, not {len(parts)}")
        return self

    def over(self, df: DataFrame) -> DataFrame:
        """Filter, group, order by the first metric descending, limit; raw rows without metrics."""
        rows = df.filter(reduce(and_, (p.condition for p in self.predicates))) if self.predicates else df
        if not self.metrics:
            return rows.select(*(self.dimensions or df.columns)).limit(self.limit)
        medians = [q for q in (m.median for m in self.metrics) if q]
        plain = [m.plain for m in self.metrics if not m.median]
        answered = percentiles.grouped(rows, list(self.dimensions), plain, medians)
        shown = answered.select(*self.dimensions, *[_q(m.name) for m in self.metrics])
        # Dimensions break ties so a limited answer is the same on every run.
        return shown.orderBy(F.col(_q(self.metrics[0].name)).desc_nulls_last(), *self.dimensions).limit(self.limit)


def _predicates(given: Sequence[Mapping[str, Any]] | None, column: str, operator: str, value: str) -> tuple[Predicate, ...]:
    """Filters in the caller's field names; those without a column say nothing."""
    return tuple(
        Predicate(f[column], str(f.get(operator) or "==").upper(), f.get(value)) for f in given or () if f.get(column)
    )


def spec_filters(filters: Sequence[Mapping[str, Any]] | None) -> Column | None:
    """All filters of a spec ANDed, or None."""
    conditions = [p.condition for p in _predicates(filters, "col", "op", "val")]
    return reduce(and_, conditions) if conditions else None


def metric_label(label: str, agg: str) -> str:
    """The label with its aggregate's words behind it, once: whole words are compared."""
    ending = AGGREGATES[agg].word.split()
    words = label.split()
    return label if words[-len(ending):] == ending else " ".join((label, *ending))


def row_limit(limit: Any, max_limit: int = MAX_LIMIT) -> int:
    """The asked number of rows (none asked: the default); more than ``max_limit`` is an error, not a silent cut."""
    asked = int(limit or DEFAULT_LIMIT)
    if not 1 <= asked <= max_limit:
        raise SpecError(f"limit must be between 1 and {max_limit}")
    return asked


def analyze(
    df: DataFrame, spec: Mapping[str, Any], labels: Mapping[str, str] | None = None, *, max_limit: int = MAX_LIMIT
) -> DataFrame:
    """Answer a spec."""
    ask = Ask.of_spec(spec, labels, max_limit)
    return ask.fit(str(spec.get("viz") or "table").lower(), df.columns).over(df)


def saved_chart_query(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Answer a stored chart."""
    return Ask.of_chart(params).over(df)


def _q(name: str) -> str:
    return f"`{name}`"


def column_roles(
    schema: T.StructType, documented: Sequence[str] = (), labels: Mapping[str, str] | None = None
) -> list[dict[str, str]]:
    """Role hint per column: numeric → measure, temporal → time, else dimension."""
    present = {f.name: f.dataType for f in schema.fields}
    order = [c for c in documented if c in present]
    order += [c for c in present if c not in set(order)]
    return [
        {"name": c, "label": (labels or {}).get(c) or c, "type": present[c].simpleString().upper(),
         "role": _role(present[c])}
        for c in order
    ]


def _role(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "measure"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "dimension"


def column_role(type_name: Column) -> Column:
    """The same hint over a table of type names (``information_schema``-like text)."""
    upper = F.upper(type_name)
    numeric = upper.rlike("INT|DEC|NUMER|DOUBLE|FLOAT|REAL")
    temporal = upper.rlike("DATE|TIME")
    return F.when(numeric, "measure").when(temporal, "time").otherwise("dimension")


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Output headers from display labels."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if labels.get(c)})
