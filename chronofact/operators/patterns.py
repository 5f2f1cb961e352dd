"""Patterns: terms aligned to an index's leading columns, compiled to column predicates.

A term is a constant, a variable "?x", ANY or None (anything), a Match, or a
Constant, which wraps a value that would read as one of the others. A
pattern may be shorter than the row. A variable that is repeated inside one
pattern keeps its last occurrence and is no equality; strict=True makes it one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


@dataclass(frozen=True)
class Match:
    """A predicate on a column, which may bind it (key) and bound the scan from below (minimum)."""

    test: Callable[[Column], Column] | None = None
    key: str | None = None
    minimum: Any = None
    original: str | None = None


@dataclass(frozen=True)
class Constant:
    """A value that is meant as it is, also one that begins with a question mark, or is "*" or null."""

    value: Any


def starts_with(prefix: str, key: str | None = None) -> Match:
    return Match(lambda c: c.startswith(prefix), key, prefix)


def equals(key: str, value: Any) -> Match:
    return Match(lambda c: c == F.lit(value), key, value)


def rename(term: Any, new: str) -> Match:
    """The same column and predicate under another name."""
    if isinstance(term, Match):
        return replace(term, key=new, original=term.original or term.key)
    return Match(None, new, None, variable_name(term))


def is_variable(term: Any) -> bool:
    return isinstance(term, str) and term.startswith("?") and len(term) > 1


def is_anything(term: Any) -> bool:
    return term is None or term == ANY


def is_constant(term: Any) -> bool:
    return not (is_anything(term) or is_variable(term) or isinstance(term, Match))


def constant_value(term: Any) -> Any:
    return term.value if isinstance(term, Constant) else term


def variable_name(term: Any) -> str | None:
    """What the term binds, without its question mark."""
    if is_variable(term):
        return term[1:]
    return term.key if isinstance(term, Match) and term.key else None


def variables(pattern: list) -> list[str]:
    """Names in order of their first occurrence."""
    return list(dict.fromkeys(n for n in map(variable_name, pattern) if n))


def has_trailing_conditions(pattern: list) -> bool:
    """Whether a condition follows a free column."""
    free = False
    for term in pattern:
        restricts = is_constant(term) or isinstance(term, Match) and term.test is not None
        if restricts and free:
            return True
        free = free or not restricts
    return False


def constant_prefix(pattern: list) -> list:
    out = []
    for term in pattern:
        if not is_constant(term) or constant_value(term) is None:
            break
        out.append(constant_value(term))
    return out


def start_row(pattern: list) -> list:
    """Values from which the scan starts: constants and minimums, null where a column is free."""
    return [constant_value(t) if is_constant(t) else t.minimum if isinstance(t, Match) else None for t in pattern]


def term_matches(column: Column, term: Any) -> Column | None:
    """The term's predicate, or None if it has none."""
    if is_constant(term):
        value = constant_value(term)
        return column.isNull() if value is None else column == F.lit(value)
    if isinstance(term, Match) and term.test is not None:
        return term.test(column)
    return None


def lower_bound(columns: list[str], pattern: list) -> Column | None:
    """The start row as a bound in row order; free columns sort first, so what follows one has no effect."""
    start = start_row(pattern)
    bounded = []
    for name, value in zip(columns, start):
        if value is None:
            break
        bounded.append((name, value))
    if not any(isinstance(t, Match) and t.minimum is not None for t in pattern[: len(bounded)]):
        return None
    if len(bounded) == 1:
        return F.col(bounded[0][0]) >= F.lit(bounded[0][1])
    fixed = [F.col(n) == F.lit(v) for (n, v), t in zip(bounded, pattern) if is_constant(t)]
    if len(fixed) == len(bounded) - 1 and not is_constant(pattern[len(bounded) - 1]):
        return F.col(bounded[-1][0]) >= F.lit(bounded[-1][1])  # the constants are predicates already
    return F.struct(*[F.col(n) for n, _ in bounded]) >= F.struct(*[F.lit(v).alias(n) for n, v in bounded])


def predicate(columns: list[str], pattern: list, strict: bool = False) -> Column | None:
    if len(pattern) > len(columns):
        raise ValueError(f"a pattern of {len(pattern)} terms for {len(columns)} columns")
    parts = [p for c, t in zip(columns, pattern) if (p := term_matches(F.col(c), t)) is not None]
    bound = lower_bound(columns, pattern)
    if bound is not None:
        parts.append(bound)
    if strict:
        seen: dict[str, str] = {}
        for c, t in zip(columns, pattern):
            n = variable_name(t)
            if n in seen:
                parts.append(F.col(seen[n]) == F.col(c))
            elif n:
                seen[n] = c
    return reduce(lambda a, b: a & b, parts) if parts else None


def bindings(columns: list[str], pattern: list) -> list[Column]:
    """A column for each variable; the last occurrence wins."""
    found = {n: c for c, t in zip(columns, pattern) if (n := variable_name(t))}
    return [F.col(c).alias(n) for n, c in found.items()]


def check_pattern(columns: list[str], pattern: list) -> None:
    """For named indexes: variables must be named like their columns."""
    if len(pattern) > len(columns):
        raise ValueError(f"pattern {pattern} is longer than {columns}")
    for c, t in zip(columns, pattern):
        n = t.original or t.key if isinstance(t, Match) else variable_name(t)
        if n and n != c:
            raise ValueError(f"variable {n} stands at column {c}")


def substitute(pattern: list, values: dict[str, Any]) -> list:
    """Bound variables become constants; a Match keeps its predicate."""
    out = []
    for t in pattern:
        n = variable_name(t)
        if n is None or values.get(n) is None:
            out.append(t)
        elif isinstance(t, Match) and t.test is not None:
            value, test = values[n], t.test
            out.append(replace(t, test=lambda c, value=value, test=test: (c == F.lit(value)) & test(c)))
        else:
            out.append(Constant(values[n]))
    return out


def matching(df: DataFrame, columns: list[str], pattern: list, strict: bool = False) -> DataFrame:
    condition = predicate(columns, pattern, strict)
    return df if condition is None else df.filter(condition)
