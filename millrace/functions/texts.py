"""Text expressions: search, rule conditions, stable group ids, object keys, model SQL checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(needle: str, cols: Sequence[Column]) -> Column:
    """Case-insensitive substring over the columns joined by blanks."""
    return F.lower(F.concat_ws(" ", *cols)).contains(needle.strip().lower())


def any_cell_contains(needle: str, cols: Sequence[Column]) -> Column:
    return F.exists(
        F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]),
        lambda v: F.lower(v).contains(needle.lower()),
    )


SHOWN = 6  # fixed value: entries of a list that a screen shows


def condition_text(check: Column, args: Column, *, shown: int | None = SHOWN) -> Column:
    """``type (k=v · k=v)`` from a map whose values are arrays of text; of a list all or the first ``shown`` entries."""
    parts = F.transform(
        F.map_entries(args),
        lambda e: F.concat(e["key"], F.lit("="), F.concat_ws(", ", e["value"] if shown is None else F.slice(e["value"], 1, shown))),
    )
    return F.when(
        F.coalesce(F.size(args), F.lit(0)) > 0,
        F.concat(check, F.lit(" ("), F.concat_ws(" · ", parts), F.lit(")")),
    ).otherwise(check)


def parse_condition(cond: Column) -> Column:
    """The argument map of a condition text; empty unless it ends in a closing bracket."""
    inner = F.regexp_extract(cond, r"(?s)^[^(]*\((.*)\)$", 1)
    pairs = F.filter(F.split(inner, " · "), lambda p: F.instr(p, "=") > 1)
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as an unsigned value in a long."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(
        codes,
        F.lit(0x811C9DC5).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193).cast("long")).bitwiseAND(
            F.lit(0xFFFFFFFF).cast("long")
        ),
    )


def group_number(key: Column) -> Column:
    return F.concat(F.lit("R-"), (F.lit(1000) + fnv1a32(key) % 9000).cast("string"))


_LAKE_ROOT = "ducklake"
_BUILD_SUFFIX = "__dbt_tmp"


def object_key(key: Column) -> Column:
    """Object key → struct(schema, table, area), null where the key is not a table file."""
    p = F.split(key, "/", -1)
    lake = p[0] == _LAKE_ROOT
    table = F.regexp_replace(F.get(p, F.lit(2)), f"{_BUILD_SUFFIX}$", "")
    return (
        F.when(
            lake & (F.size(p) >= 4),
            F.struct(
                F.get(p, F.lit(1)).alias("schema"), table.alias("table"), F.lit("data").alias("area")
            ),
        )
        .when(lake, F.lit(None))
        .when(
            F.size(p) >= 3,
            F.struct(
                p[0].alias("schema"), F.get(p, F.lit(1)).alias("table"), F.get(p, F.lit(2)).alias("area")
            ),
        )
    )


# The words that open a statement which changes data, and the words that may follow them.
_OBJECTS = ("table", "view", "schema", "database")
_CHANGES = {
    "alter": ("table",), "create": _OBJECTS, "delete": ("from",), "drop": _OBJECTS, "insert": ("into",),
    "merge": ("into",), "truncate": ("table",),
}
_RIGHTS = ("grant", "revoke")
_SKIPPED = r"--[^\n]*|(?s:/\*.*?\*/)"
_TOKEN = rf"{_SKIPPED}|(?s:\{{%.*?%\}})|'[^']*'|\w+|[^\w\s]"
_NAME = r"^[A-Za-z_]\w*$"


def sql_tokens(sql: Column) -> Column:
    """Words, whole string literals and single signs of a SQL text, in order, as written; comments and template blocks go.

    Literals and comments are told apart by which opens first, so a comment sign in a literal is text.
    """
    dropped = (lambda t: t.startswith("--") | t.startswith("/*") | t.startswith("{%"))
    return F.filter(F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), lambda t: ~dropped(t))


class TokenScan:
    """Counts over a column of ``sql_tokens``. Give a plain column: the array is looked into at every position."""

    def __init__(self, tokens: Column):
        self._tokens = tokens

    def _word(self, at: Column) -> Column:
        """The lower-cased token at a position, the empty text outside the array."""
        inside = (at >= 0) & (at < F.size(self._tokens))
        return F.when(inside, F.lower(F.get(self._tokens, at))).otherwise("")

    def _count(self, holds: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(self._tokens, lambda _, at: holds(at)))

    def statements(self) -> Column:
        """Stretches between semicolons that hold a token."""
        return self._count(lambda at: (self._word(at) != ";") & self._word(at - 1).isin("", ";"))

    def selects(self) -> Column:
        return self._count(lambda at: self._word(at) == "select")

    def ctes(self) -> Column:
        """Names that ``with`` or a comma introduces and ``as (`` follows."""
        return self._count(
            lambda at: self._word(at - 1).isin("with", ",") & self._word(at).rlike(_NAME)
            & (self._word(at + 1) == "as") & (self._word(at + 2) == "(")
        )

    def change(self) -> Column:
        """The first words, as written, that open a change of data, tables or rights; null if there are none."""
        follows = F.create_map(*[F.lit(x) for verb, after in _CHANGES.items() for x in (verb, list(after))])

        def length(at: Column) -> Column:
            verb, second, third = (self._word(at + k) for k in range(3))
            replacing = (verb == "create") & (second == "or") & (third == "replace") & self._word(at + 3).isin(*_OBJECTS)
            return (
                F.when(F.array_contains(F.coalesce(F.try_element_at(follows, verb), F.array().cast("array<string>")), second), 2)
                .when((verb == "update") & second.rlike(r"^\w") & (third == "set"), 3)
                .when(verb.isin(*_RIGHTS) & second.rlike(r"^\w"), 1)
                .when(replacing, 4).otherwise(0)
            )

        found = F.filter(
            F.transform(self._tokens, lambda _, at: F.struct(at.alias("at"), length(at).alias("n"))), lambda f: f["n"] > 0
        )
        first = F.get(found, F.lit(0))
        return F.when(first.isNotNull(), F.array_join(F.slice(self._tokens, first["at"] + 1, first["n"]), " "))


def _template_call(sql: Column, name: str, arguments: int) -> list[Column]:
    """The quoted arguments of every ``{{ name(...) }}`` outside comments: one list of texts per argument."""
    quoted = r"['\"]([^'\"]+)['\"]"
    call = rf"{name}\s*\(\s*" + r"\s*,\s*".join([quoted] * arguments) + r"\s*\)"
    text = F.regexp_replace(sql, _SKIPPED, " ")
    return [
        F.regexp_extract_all(text, F.lit(rf"\{{\{{\s*{call}\s*\}}\}}"), F.lit(k + 1)) for k in range(arguments)
    ]


def referenced_models(sql: Column) -> Column:
    return F.array_distinct(*_template_call(sql, "ref", 1))


def referenced_sources(sql: Column) -> Column:
    pairs = F.zip_with(*_template_call(sql, "source", 2), lambda schema, table: F.concat_ws(".", schema, table))
    return F.array_distinct(pairs)
