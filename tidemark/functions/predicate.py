"""The WHERE language of subscriptions as Spark columns.

`name op literal`, LIKE, IS [NOT] NULL, AND, OR, NOT and parentheses. A comparison with NULL, with a missing column or between
types that differ is false, and NOT negates that false. Keywords are case-insensitive, names are not. A clause that
doesn't parse raises ValueError with the position, before Spark sees anything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?![\w.]))|(<=|>=|<>|!=|=|<|>|\(|\)|\*|,)|([A-Za-z_]\w*))")
_KEYWORDS = {"AND", "OR", "NOT", "IS", "NULL", "LIKE", "TRUE", "FALSE"}
_OPS: dict[str, Callable[[Any, Any], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
#: Whole numbers up to here are doubles exactly, so comparing them as they are gives what doubles would.
_EXACT = 1 << 53


class Test(NamedTuple):
    """A leaf: name, operator (a comparison, LIKE, NULL or NOT NULL) and literal."""

    name: str
    op: str
    value: Any = None


class Junction(NamedTuple):
    op: str  # AND, OR, NOT
    parts: tuple


def tokens(text: str) -> list[tuple[str, Any, int]]:
    """(kind, value, position) of each token of a text, and an end; signs and upper-cased keywords are their own kind."""
    found: list[tuple[str, Any, int]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at position {at}: {text[at:].strip()[:10]!r}")
        quoted, number, sign, word = m.groups()
        if quoted is not None:
            found.append(("literal", quoted[1:-1].replace("''", "'"), m.start(1)))
        elif number is not None:
            found.append(("literal", float(number) if "." in number else int(number), m.start(2)))
        elif sign is not None:
            found.append((sign, sign, m.start(3)))
        else:
            key = word.upper()
            found.append((key if key in _KEYWORDS else "name", word, m.start(4)))
        at = m.end()
    return [*found, ("end", "", len(text))]


def parse(clause: str | list[tuple[str, Any, int]]) -> Test | Junction:
    """A clause, or its tokens, as a tree."""
    read = tokens(clause) if isinstance(clause, str) else clause
    where = 0

    def take(*kinds: str) -> Any:
        nonlocal where
        kind, value, position = read[where]
        if kind not in kinds:
            raise ValueError(f"expected {' or '.join(kinds)} at position {position}, found {value!r}")
        where += 1
        return kind, value

    def junction(op: str, below: Callable[[], Any]) -> Any:
        parts = [below()]
        while read[where][0] == op:
            take(op)
            parts.append(below())
        return parts[0] if len(parts) == 1 else Junction(op, tuple(parts))

    def negation() -> Any:
        if read[where][0] == "NOT":
            take("NOT")
            return Junction("NOT", (negation(),))
        if read[where][0] == "(":
            take("(")
            inner = disjunction()
            take(")")
            return inner
        return leaf()

    def leaf() -> Test:
        _, name = take("name")
        kind, _ = take("IS", "LIKE", *_OPS)
        if kind == "IS":
            no = read[where][0] == "NOT"
            if no:
                take("NOT")
            take("NULL")
            return Test(name, "NOT NULL" if no else "NULL")
        if kind == "LIKE":
            _, value = take("literal")
            if not isinstance(value, str):
                raise ValueError("LIKE needs a string")
            return Test(name, "LIKE", value)
        what, value = take("literal", "TRUE", "FALSE", "NULL")
        return Test(name, kind, {"TRUE": True, "FALSE": False, "NULL": None}.get(what, value))

    def disjunction() -> Any:
        return junction("OR", lambda: junction("AND", negation))

    tree = disjunction()
    take("end")
    return tree


def like_pattern(pattern: str) -> str:
    """For Spark's LIKE, where a backslash escapes; here it stands for itself."""
    return pattern.replace("\\", "\\\\")


def strict_like(column: Column, pattern: str) -> Column:
    """LIKE whose wildcards don't cross line ends; not pushed to files."""
    return column.rlike(r"\A" + "".join({"%": r"[^\n\r]*", "_": r"[^\n\r]"}.get(c, re.escape(c)) for c in pattern) + r"\z")


def _fold(tree: Test | Junction, leaf: Callable[[Test], Column]) -> Column:
    """AND and OR of three values give the rows of two under a filter; only NOT must see false for unknown.

    Comparisons elsewhere stay bare, so that Spark pushes them to the files.
    """
    if isinstance(tree, Test):
        return leaf(tree)
    parts = [_fold(p, leaf) for p in tree.parts]
    if tree.op == "NOT":
        return ~F.coalesce(parts[0], F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out & part if tree.op == "AND" else out | part
    return out


def compile_typed(clause: str | Test | Junction, schema: T.StructType, column: Callable[[str], Column] = F.col, strict: bool = False) -> Column:
    """A filter over columns of known types. `column` finds one by name, for structs."""
    types = {f.name: f.dataType for f in schema}

    def leaf(t: Test) -> Column:
        if t.name not in types:
            return F.lit(t.op == "NULL")
        kind, at = types[t.name], column(f"`{t.name}`" if column is F.col else t.name)
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        if t.op in ("NULL", "NOT NULL"):
            nothing = at.isNull() | F.isnan(at) if floating else at.isNull()
            return nothing if t.op == "NULL" else ~nothing if floating else at.isNotNull()
        if t.op == "LIKE":
            return (strict_like(at, t.value) if strict else at.like(like_pattern(t.value))) if isinstance(kind, T.StringType) else F.lit(False)
        if isinstance(t.value, bool):
            return _OPS[t.op](at, F.lit(t.value)) if isinstance(kind, T.BooleanType) and t.op in ("=", "!=", "<>") else F.lit(False)
        if isinstance(t.value, str):
            return _OPS[t.op](at, F.lit(t.value)) if isinstance(kind, T.StringType) else F.lit(False)
        if t.value is None or not isinstance(kind, T.NumericType):
            return F.lit(False)
        if isinstance(kind, T.IntegralType) and float(t.value).is_integer() and abs(t.value) <= _EXACT:
            return _OPS[t.op](at, F.lit(int(t.value)))
        compared = _OPS[t.op](at if isinstance(kind, T.DoubleType) else at.cast("double"), F.lit(float(t.value)))
        return compared & ~F.isnan(at) if floating and t.op not in ("=", "<", "<=") else compared

    return _fold(parse(clause) if isinstance(clause, str) else clause, leaf)


def compile_variant(clause: str | Test | Junction, row: Column, strict: bool = False) -> Column:
    """A filter over a VARIANT object whose members have any type, told row by row; other variants match nothing."""

    def leaf(t: Test) -> Column:
        path = F.variant_get(row, f"$.{t.name}", "variant")
        kind = F.schema_of_variant(path)
        if t.op in ("NULL", "NOT NULL"):
            nothing = path.isNull() | F.is_variant_null(path)
            return nothing if t.op == "NULL" else ~nothing
        text = F.when(kind == "STRING", F.try_variant_get(row, f"$.{t.name}", "string"))
        if t.op == "LIKE":
            return strict_like(text, t.value) if strict else text.like(like_pattern(t.value))
        if t.value is None:
            return F.lit(False)
        if isinstance(t.value, bool):
            truth = F.when(kind == "BOOLEAN", F.try_variant_get(row, f"$.{t.name}", "boolean"))
            return _OPS[t.op](truth, F.lit(t.value)) if t.op in ("=", "!=", "<>") else F.lit(False)
        if isinstance(t.value, str):
            return _OPS[t.op](text, F.lit(t.value))
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(row, f"$.{t.name}", "double"))
        return _OPS[t.op](number, F.lit(float(t.value)))

    tree = _fold(parse(clause) if isinstance(clause, str) else clause, leaf)
    return F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False)) & F.coalesce(tree, F.lit(False))
