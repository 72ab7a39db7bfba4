"""Predicates as Columns: two-valued comparisons, filter lists and condition trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import tokens

NUMERIC = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def truth(predicate: Column) -> Column:
    """Two-valued: NULL is false."""
    return F.coalesce(predicate, F.lit(False))


def in_list(value: Column, items: list) -> Column:
    """NULL is in no list, and NULL items match nothing."""
    return truth(value.isin([x for x in items if x is not None]))


def not_in_list(value: Column, items: list) -> Column:
    """False for NULL; NULL items are ignored."""
    return value.isNotNull() & ~in_list(value, items)


def like(value: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return truth(value.ilike(pattern))


def glob(value: Column, pattern: str) -> Column:
    """* stands for any run and ? for one character."""
    special = set(".^$+{}[]()|\\")
    text = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in special else c for c in pattern)
    return truth(value.rlike(f"(?s)^{text}$"))


def bare(value: Column, op: str, operand: Any) -> Column:
    """One comparison of a filter: equality of text, ranges of numbers, contains and prefix; NULL on NULL.

    As it stands a where clause can hand it to the scan, if the column has the type compared.
    """
    if op in ("=", "=="):
        return value.cast("string") == F.lit(operand).cast("string")
    if op in ("!=", "<>"):
        return value.cast("string") != F.lit(operand).cast("string")
    if op == "contains":
        return F.contains(F.lower(value.cast("string")), F.lit(str(operand).lower()))
    if op == "prefix":
        return F.startswith(F.lower(value.cast("string")), F.lit(str(operand).lower()))
    if op in NUMERIC:
        return getattr(value.try_cast("double"), NUMERIC[op])(F.lit(operand).try_cast("double"))
    raise ValueError(f"unknown operator {op}")


def compare(value: Column, op: str, operand: Any) -> Column:
    """The same, false on NULL, for use under NOT and in results."""
    return truth(bare(value, op, operand))


def all_of(filters: list[tuple[str, str, Any]]) -> Column:
    """A list of (column, operator, operand), all of which must hold; for a where clause, which drops NULL as false."""
    return reduce(lambda a, b: a & b, (bare(F.col(c), op, x) for c, op, x in filters), F.lit(True))


@dataclass(frozen=True)
class Condition:
    """A node of a condition tree.

    A group has children under op "and" or "or". A leaf tests any of its fields against any of its
    values with its comparison; a full-text leaf asks for all words of its query in one of its fields.
    """

    op: str = "and"
    children: list[Condition] = field(default_factory=list)
    negate: bool = False
    fields: list[str] = field(default_factory=list)
    comparison: str = "="
    values: list[Any] = field(default_factory=list)
    full_text: str = ""

    def column(self) -> Column:
        out = self.leaf() if self.fields else self.group()
        return ~out if self.negate else out

    def group(self) -> Column:
        parts = [c.column() for c in self.children]
        if not parts:
            return F.lit(True)
        return reduce((lambda a, b: a | b) if self.op == "or" else (lambda a, b: a & b), parts)

    def leaf(self) -> Column:
        if self.full_text:
            words = self.full_text.lower().split()
            tests = [reduce(lambda a, b: a & b, (F.array_contains(tokens(F.col(f)), w) for w in words)) for f in self.fields]
        else:
            tests = [compare(F.col(f), self.comparison, v) for f in self.fields for v in self.values]
        return reduce(lambda a, b: a | b, map(truth, tests), F.lit(False))
