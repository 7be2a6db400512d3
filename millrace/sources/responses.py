"""Landed API responses: records at a path, failures inside a success, completeness of paging.

A responses table holds one body per row: ``(call_id, page, body)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import running

MAX_PAGES = 500
# Result codes that mean success.
OK_CODES = ("0", "00", "000", "0000", "OK")


def _parts(path: str) -> list[str]:
    return [p for p in path.split(".") if p]


def _json_path(parts: list[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in parts)


def _is_empty(v: Column) -> Column:
    return v.isNull() | F.to_json(v).isin("null", '""', "{}", "[]")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _as_records(found: Column) -> Column:
    """The record maps a value holds: of an array its objects, of an object itself."""
    elements = F.transform(
        F.try_variant_get(found, "$", "array<variant>"),
        lambda e: F.try_variant_get(e, "$", "map<string,string>"),
    )
    single = F.try_variant_get(found, "$", "map<string,string>")
    return F.coalesce(
        F.filter(elements, lambda r: r.isNotNull()), F.when(single.isNotNull(), F.array(single))
    )


def walk_outcomes(responses: DataFrame, record_path: str) -> DataFrame:
    """What each JSON body holds at the path.

    ``outcome`` is ``records``, ``empty`` (an empty value on the way or at the end: no data),
    ``path_error`` (a key is missing although there was something to look in), ``not_records`` or
    ``not_json``; ``records`` holds the record maps. The body is parsed once and only bodies whose
    walk breaks off are looked at again.
    """
    parts = _parts(record_path)
    walked = responses.withColumn("_v0", F.try_parse_json("body"))
    for i, part in enumerate(parts):
        walked = walked.withColumn(f"_v{i + 1}", F.try_variant_get(f"_v{i}", _json_path([part]), "variant"))
    state = F.when(F.col("_v0").isNull(), "not_json")
    for i in range(len(parts)):
        broken = F.col(f"_v{i + 1}").isNull()
        state = state.when(broken & _is_empty(F.col(f"_v{i}")), "empty").when(broken, "path_error")
    found = F.col(f"_v{len(parts)}")
    walked = walked.withColumn("records", _as_records(found))
    state = (
        state.when(F.size("records") > 0, "records")
        .when(F.to_json(found).isin("null", '""', "[]"), "empty").otherwise("not_records")
    )
    return walked.select(*responses.columns, state.alias("outcome"), "records")


def records_from_json(responses: DataFrame, record_path: str, *, strict: bool = True) -> DataFrame:
    """One row per record object: ``(…, pos, record)`` with the record as a map of strings.

    A single object is one record; non-objects in an array are passed over. ``strict`` stops the
    query at a path error, scalars or a body that is no JSON; otherwise such bodies give no rows.
    """
    walked = walk_outcomes(responses, record_path)
    records = F.col("records")
    if strict:
        wrong = F.col("outcome").isin("path_error", "not_records", "not_json")
        problem = F.raise_error(F.concat(F.lit(f"{record_path}: "), F.col("outcome")))
        records = F.when(wrong, problem.cast(walked.schema["records"].dataType)).otherwise(records)
    keep = [c for c in responses.columns if c != "body"]
    return walked.select(*keep, F.posexplode(records).alias("pos", "record"))


def xml_outcomes(responses: DataFrame, record_path: str) -> DataFrame:
    """The same outcomes for XML bodies; the root tag is the first part of the path.

    One expression asks all questions of a body, so it is parsed once: it gives a 0 or 1 for each, and the first 1
    decides.
    """
    parts = _parts(record_path)
    asked = []
    for i in range(1, len(parts)):
        here = "/" + "/".join(parts[:i])
        asked += [(f"not({here})", "path_error"), (f"not({here}/*) and normalize-space({here})=''", "empty")]
    full = "/" + "/".join(parts)
    asked += [
        (f"not({full})", "path_error"), (f"boolean({full}/*)", "records"),
        (f"normalize-space({full})=''", "empty"), ("true()", "not_records"),
    ]
    answers = F.xpath_string("body", F.lit(f"concat({', '.join(f'number({q})' for q, _ in asked)}, '')"))
    outcome = F.get(F.array(*[F.lit(o) for _, o in asked]), F.instr(answers, "1") - 1)
    state = F.when(~F.ltrim("body").startswith("<"), "not_xml").otherwise(F.coalesce(outcome, F.lit("not_records")))
    return responses.withColumn("outcome", state)


def records_from_xml(responses: DataFrame, record_path: str, *, strict: bool = True) -> DataFrame:
    """One row per record element: leaf text trimmed, attributes dropped, a repeated tag is an array."""
    parts = _parts(record_path)
    if len(parts) < 2:
        raise ValueError("the record path names the root tag and at least one tag inside it")
    inside = reduce(
        lambda inner, p: f"struct<`{p}`: {inner}>", reversed(parts[2:]), "array<map<string,string>>"
    )
    body_schema = f"`{parts[1]}` {inside}"
    walked = xml_outcomes(responses, record_path)
    if strict:
        wrong = F.col("outcome").isin("path_error", "not_records", "not_xml")
        walked = walked.withColumn(
            "outcome",
            F.when(wrong, F.raise_error(F.concat(F.lit(f"{record_path}: "), F.col("outcome"))))
            .otherwise(F.col("outcome")),
        )
    parsed = F.from_xml("body", body_schema, {"excludeAttribute": "true"})
    keep = [c for c in responses.columns if c != "body"]
    at = ".".join(["_x", *[f"`{p}`" for p in parts[1:]]])
    return (
        walked.filter(F.col("outcome") == "records").withColumn("_x", parsed)
        .select(*keep, F.posexplode(F.col(at)).alias("pos", "record"))
    )


# The parts of an XML body in which a source reports a failure.
_ENVELOPES = "cmmMsgHeader map<string,string>, header map<string,string>"
_ROOT_TAG = r"(?s)^\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)\s*)*<([A-Za-z_][\w.:-]*)"


def flag_error_bodies(responses: DataFrame) -> DataFrame:
    """Failures a source reports inside a success, in JSON or XML; only exact shapes count.

    A body that is no JSON is read as XML, once, and only if its root tag can hold a failure. Broken bodies report none.
    """
    service, ordinary = ("OpenAPI_ServiceResponse", "cmmMsgHeader"), [(key, "header") for key in ("Response", "response")]
    roots = [service[0], *(key for key, _ in ordinary)]
    read = (
        responses.withColumn("_json", F.try_parse_json("body"))
        .withColumn("_root", F.when(F.col("_json").isNull(), F.regexp_extract("body", _ROOT_TAG, 1)))
        .withColumn("_xml", F.from_xml(F.when(F.col("_root").isin(*roots), F.col("body")), _ENVELOPES, {"excludeAttribute": "true"}))
    )

    def elements(head: tuple[str, str]) -> Column:
        return F.when(F.col("_root") == head[0], F.col(f"_xml.{head[1]}"))

    def found(head: tuple[str, str], field: str) -> Column:
        given = F.try_variant_get("_json", _json_path([*head, field]), "string")
        return F.trim(F.coalesce(given, F.try_element_at(elements(head), F.lit(field)), F.lit("")))

    def present(head: tuple[str, str]) -> Column:
        kind = _kind(F.try_variant_get("_json", _json_path(list(head)), "variant"))
        return F.coalesce(kind == "OBJECT", F.size(elements(head)) > 0, F.lit(False))

    def first_text(head: tuple[str, str], *fields: str) -> Column:
        texts = [found(head, f) for f in fields]
        return reduce(lambda other, t: F.when(t != "", t).otherwise(other), reversed(texts))

    def reported(head: tuple[str, str]) -> Column:
        """The result code, null where there is none or it means success."""
        given = F.try_variant_get("_json", _json_path([*head, "resultCode"]), "variant").isNotNull()
        has_code = given | F.coalesce(F.map_contains_key(elements(head), "resultCode"), F.lit(False))
        code = F.when(has_code, found(head, "resultCode")).otherwise(found(head, "returnReasonCode"))
        return F.when(present(head) & (code != "") & ~code.isin(*OK_CODES), code)

    failed = F.when(present(service), F.struct(
        found(service, "returnReasonCode").alias("code"), first_text(service, "returnAuthMsg", "errMsg").alias("message"),
    ))
    for head in reversed(ordinary):
        failed = failed.when(reported(head).isNotNull(), F.struct(
            reported(head).alias("code"), first_text(head, "resultMsg", "returnAuthMsg").alias("message"),
        ))
    read = read.withColumn("_failed", failed)
    return read.select(
        *responses.columns, F.col("_failed").isNotNull().alias("is_error"),
        F.col("_failed.code").alias("error_code"), F.col("_failed.message").alias("error_message"),
    )


def running_page_total(pages: DataFrame) -> DataFrame:
    """Rows collected per call up to each page, in page order."""
    return running(pages, ["call_id"], ["page"], number="nth_page", sums={"collected": "rows"})


def page_completeness(pages: DataFrame, *, size: int | str = 0) -> DataFrame:
    """Per call: rows, declared total, and whether paging stopped where it should.

    ``pages(call_id, page, rows, total)``; ``size`` is the asked page size of all calls, or names a column that holds
    each call's own (0 or null: not known). A page ends the call when the declared total is reached, when it is short or
    empty, or when neither size nor total is known. ``MAX_PAGES`` pages without an end are an error, not a cut.
    """
    along = running_page_total(pages)
    size = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if isinstance(size, str) else F.lit(size)
    total = F.col("total").try_cast("bigint")
    ends = (
        F.coalesce(F.col("collected") >= total, F.lit(False)) | (F.col("rows") == 0)
        | ((size > 0) & (F.col("rows") < size)) | (total.isNull() & (size <= 0))
    )
    per_call = along.withColumn("_ends", ends).groupBy("call_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows"),
        F.max_by(total, "page").alias("declared"),
        F.max_by("_ends", "page").alias("_last_ends"), F.count_if("_ends").alias("_n_ends"),
    )
    verdict = (
        F.when((F.col("pages") > MAX_PAGES) | ((F.col("pages") == MAX_PAGES) & ~F.col("_last_ends")), "too_many_pages")
        .when(~F.col("_last_ends"), "truncated")
        .when(F.col("_n_ends") > 1, "read_past_end").otherwise("complete")
    )
    return per_call.select(
        "call_id", "pages", "rows", "declared", verdict.alias("verdict"),
        F.greatest(F.col("declared") - F.col("rows"), F.lit(0)).alias("missing"),
    )
