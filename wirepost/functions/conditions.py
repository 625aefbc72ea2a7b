"""Conditions of rules, as data: text of a closed grammar becomes a column over a struct of facts.

A condition is `path operator literal`, or `path is [not] null`, or `path is [not] empty`. Text that isn't one is an error; a
fact that is missing, null or of another kind than the literal makes a comparison false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The operators of the grammar.
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")
STATES = ("is not null", "is null", "is not empty", "is empty")
SHAPE = re.compile(rf"([A-Za-z_][\w.]*)\s*(?:({'|'.join(COMPARISONS)})\s*(\"[^\"]*\"|'[^']*'|\S*)|({'|'.join(STATES)}))\s*", re.ASCII | re.IGNORECASE)
#: Kinds of literals by their text in lower case without quotes, the first that fits; all other text is a string.
LITERALS = [("bool", "true|false"), ("null", "null|none"), ("int", r"0x[0-9a-f]+|[+-]?[0-9]+"), ("float", r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(e[+-]?[0-9]+)?")]


def kind_of(text: Column) -> Column:
    """bool, null, int, float or str: what a literal without quotes is."""
    small = F.lower(text)
    return F.coalesce(*(F.when(small.rlike(f"^({pattern})$"), kind) for kind, pattern in LITERALS), F.lit("str"))


def literal(text: str) -> bool | int | float | str | None:
    bare = text.strip("\"'")
    small = bare.lower()
    kind = next((k for k, pattern in LITERALS if re.fullmatch(pattern, small)), "str")
    return {"bool": small == "true", "null": None, "str": bare}[kind] if kind in ("bool", "null", "str") else int(small, 0 if small.startswith("0x") else 10) if kind == "int" else float(small)


def at_path(path: str, schema: T.StructType) -> tuple[Column, T.DataType | None]:
    """The column at a dotted path of structs, and its type; a null without a type where the path leads nowhere."""
    column, kind = None, schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None), None
        column, kind = (F.col(part) if column is None else column[part]), kind[part].dataType
    return column, kind


def json_at(text: Column, path: str) -> Column:
    """The text at a dotted path of a JSON object; null where it leads nowhere."""
    return F.get_json_object(text, "$." + path)


def condition(text: str, schema: T.StructType) -> Column:
    """A boolean column, never null, for a condition over columns of this schema."""
    parsed = SHAPE.fullmatch(text.strip())
    if not parsed:
        raise ValueError(f"not a condition: {text!r}")
    path, comparison, raw, state = parsed.groups()
    fact, kind = at_path(path, schema)
    if state:
        empty = fact.isNull()
        if state.lower().endswith("empty") and isinstance(kind, (T.ArrayType, T.MapType)):
            empty = empty | (F.size(fact) == 0)
        elif state.lower().endswith("empty") and isinstance(kind, T.StringType):
            empty = empty | (fact == "")
        return ~empty if " not " in state.lower() else empty
    if not raw.strip():
        raise ValueError(f"a value is missing: {text!r}")
    value = literal(raw)
    if kind is None:
        return F.lit(False)
    if value is None:
        return fact.isNotNull() if comparison == "!=" else F.lit(False)
    text_like, number_like = isinstance(kind, T.StringType), isinstance(kind, (T.NumericType, T.BooleanType))
    if isinstance(value, str) != text_like or not (text_like or number_like):
        return fact.isNotNull() if comparison == "!=" else F.lit(False)  # of different kinds: unequal, and not in any order
    known = fact.cast("double") if number_like and not isinstance(kind, T.IntegralType) else fact.cast("long") if number_like else fact
    wanted = F.lit(float(value)) if isinstance(value, (bool, float)) else F.lit(value)
    made = {"==": known == wanted, "!=": known != wanted, ">": known > wanted, ">=": known >= wanted, "<": known < wanted, "<=": known <= wanted}
    return F.coalesce(made[comparison], F.lit(False))
