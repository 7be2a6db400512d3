"""Status vocabularies: how raw test, run and task states fold into the platform's own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw status → platform status.
TEST_STATES = {"pass": "ok", "success": "ok", "warn": "warn", "fail": "err", "error": "err"}
RUN_STATES = {"success": "ok", "failed": "err", "running": "run", "queued": "run"}
TASK_STATES = {
    "success": "ok",
    "failed": "err",
    "upstream_failed": "skip",
    "skipped": "skip",
    "running": "run",
    "restarting": "run",
    "up_for_retry": "run",
    "deferred": "run",
    "queued": "wait",
    "scheduled": "wait",
    "none": "wait",
    "removed": "wait",
    "up_for_reschedule": "wait",
}
# Check name → rule type, and rule type → quality dimension.
RULE_TYPES = {
    "not_null": "notnull",
    "unique": "unique",
    "unique_combination_of_columns": "unique",
    "accepted_values": "accepted",
    "relationships": "rel",
    "accepted_range": "range",
}
RULE_LABELS = {
    "notnull": "required value",
    "unique": "duplicate",
    "accepted": "accepted values",
    "rel": "referential integrity",
    "range": "range",
    "fresh": "freshness",
    "sql": "custom SQL",
}
DIMENSIONS = {
    "notnull": "completeness",
    "accepted": "validity",
    "rel": "consistency",
    "range": "accuracy",
    "unique": "uniqueness",
    "fresh": "timeliness",
    "sql": "custom",
}
BUILD_TYPES = ("model", "seed", "snapshot")
TEST_TYPES = ("test", "unit_test")
GOOD = ("success", "pass")


def lookup(key: Column, values: Mapping[str, str], default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for raw, mapped in reversed(list(values.items())):
        out = F.when(key == raw, F.lit(mapped)).otherwise(out)
    return out


def test_state(status: Column) -> Column:
    return lookup(F.lower(status), TEST_STATES, "unknown")


def run_state(status: Column) -> Column:
    return lookup(status, RUN_STATES, "wait")


def task_state(status: Column) -> Column:
    return lookup(status, TASK_STATES, "wait")


def node_state(build_status: Column, task_status: Column, test_failed: Column) -> Column:
    """The build result decides where there is one; a built model with a failed check is an error."""
    return (
        F.when(build_status.isin("error", "fail"), "err")
        .when(build_status == "skipped", "skip")
        .when(build_status.isin(*GOOD), F.when(test_failed, "err").otherwise("ok"))
        .otherwise(task_state(task_status))
    )


def rule_type(check_name: Column) -> Column:
    bare = F.replace(check_name, F.lit("dbt_utils."), F.lit(""))
    known = lookup(bare, RULE_TYPES, None)
    return F.coalesce(known, F.when(bare.contains("freshness"), "fresh").otherwise("sql"))


def dimension(rtype: Column) -> Column:
    return lookup(rtype, DIMENSIONS, "custom")


def rule_label(rtype: Column) -> Column:
    return lookup(rtype, RULE_LABELS, None)


def worst(status: Column) -> Column:
    """Aggregate: err over warn over ok."""
    rank = F.when(status == "err", 2).when(status == "warn", 1).otherwise(0)
    top = F.max(rank)
    return F.when(top == 2, "err").when(top == 1, "warn").otherwise("ok")


def is_build(resource_type: Column) -> Column:
    return resource_type.isin(*BUILD_TYPES)


def is_test(resource_type: Column) -> Column:
    return resource_type.isin(*TEST_TYPES)


def is_bad(status: Column) -> Column:
    return ~status.isin(*GOOD)
