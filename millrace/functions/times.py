"""Time expressions: string timestamps, windows before a fixed clock, local days, display text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_time(col: str | Column) -> Column:
    """History tables keep times as text; comparing the text would order it wrongly."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp")


def clock(as_of: str | None) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def within_days(ts: Column, days: int, as_of: str | None, *, most: int = 365) -> Column:
    if not 1 <= days <= most:
        raise ValueError(f"days must be between 1 and {most}")
    return ts >= clock(as_of) - F.make_dt_interval(F.lit(int(days)))


def local_day(ts: Column, tz: str) -> Column:
    """Calendar day of an instant in ``tz``, whatever the session zone is."""
    return F.convert_timezone(None, F.lit(tz), ts.cast("timestamp_ntz")).cast("date")


def elapsed_seconds(start: Column, end: Column, digits: int = 1) -> Column:
    millis = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.round(millis / F.lit(1000.0) + F.lit(1e-9), digits)


def temporal_text(epoch_ms: Column, kind: str, tz: str) -> Column:
    """Epoch milliseconds as text: dates in UTC, timestamps in ``tz``; other values pass through."""
    number = epoch_ms.try_cast("bigint")
    instant = F.timestamp_millis(number)
    zone = "UTC" if kind.upper() == "DATE" else tz
    pattern = "yyyy-MM-dd" if kind.upper() == "DATE" else "yyyy-MM-dd HH:mm:ss"
    shown = F.date_format(
        F.convert_timezone(None, F.lit(zone), instant.cast("timestamp_ntz")), pattern
    )
    return F.when(number.isNull(), epoch_ms.cast("string")).otherwise(shown)


# The four point formats a source may ask for, as Spark datetime patterns.
POINT_FORMATS = {
    "YYYYMMDD": "yyyyMMdd",
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYYMM": "yyyyMM",
    "YYYY-MM": "yyyy-MM",
}


def point_text(day: Column, fmt: str) -> Column:
    return F.date_format(day, POINT_FORMATS.get(fmt, POINT_FORMATS["YYYY-MM-DD"]))


def shift(day: Column, unit: str, n: Column | int) -> Column:
    """Move a day by days, or by months from the first of its month."""
    steps = F.lit(n) if isinstance(n, int) else n
    if unit == "month":
        return F.add_months(F.trunc(day, "month"), steps)
    return F.date_add(day, steps)


_MARK = r"\{\{\s*(ymd|ym|date)\s*([+-]\d+)?\s*\}\}"
_LEFT = r"\{\{[^{}]*\}\}"


def fill_placeholders(template: Column, today: Column | date) -> Column:
    """Replace ``{{ymd±n}}``, ``{{date±n}}`` (days) and ``{{ym±n}}`` (months) in a text column.

    The text is cut at its marks; the pieces and the filled marks are then zipped back together,
    so a template may hold any number of marks. Any ``{{…}}`` left over stops the query.
    """
    day = today if isinstance(today, Column) else F.lit(today)
    marks = F.regexp_extract_all(template, F.lit(f"({_MARK})"), F.lit(1))
    pieces = F.split(template, _MARK, -1)

    def filled(mark: Column) -> Column:
        unit = F.regexp_extract(mark, _MARK, 1)
        text = F.regexp_extract(mark, _MARK, 2)
        n = F.when(text == "", F.lit(0)).otherwise(text.try_cast("int"))
        return (
            F.when(unit == "ymd", F.date_format(shift(day, "day", n), "yyyyMMdd"))
            .when(unit == "ym", F.date_format(shift(day, "month", n), "yyyyMM"))
            .otherwise(F.date_format(shift(day, "day", n), "yyyy-MM-dd"))
        )

    joined = F.concat_ws(
        "",
        F.flatten(
            F.zip_with(
                pieces,
                F.transform(marks, filled),
                lambda piece, mark: F.array(piece, F.coalesce(mark, F.lit(""))),
            )
        ),
    )
    return F.when(
        F.regexp_like(joined, F.lit(_LEFT)),
        F.raise_error(F.concat(F.lit("unknown placeholder "), F.regexp_extract(joined, _LEFT, 0))),
    ).otherwise(joined)
