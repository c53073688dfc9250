"""One predicate grammar for filters, HAVING, pruning and pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}
ALIASES = {"eq": "==", "ne": "!=", "<>": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "=": "=="}
TEXT = {
    "contains": lambda c, v: c.cast("string").rlike(v), "matches": lambda c, v: c.cast("string").rlike(v), "like": lambda c, v: c.like(v),
    "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v),
}


def _scalar(x) -> bool:
    return not isinstance(x, (list, tuple, set, dict))


def condition(column: str | Column, spec) -> Column:
    """None is a null test, a list membership, (op, value) a comparison, (low, high) a closed range, else equality."""
    c = F.col(column) if isinstance(column, str) else column
    if spec is None:
        return c.isNull()
    if isinstance(spec, (list, set)):
        return c.isin(list(spec)) if spec else F.lit(False)
    if isinstance(spec, tuple):
        head = spec[0] if spec else None
        if len(spec) == 1 and head in ("isnull", "notnull"):
            return c.isNull() if head == "isnull" else c.isNotNull()
        if len(spec) == 2 and isinstance(head, str):
            op, value = ALIASES.get(head, head), spec[1]
            if op in COMPARE:
                return COMPARE[op](c, value)
            if op in TEXT:
                return TEXT[op](c, value)
            if op in ("isin", "in"):
                return condition(c, list(value))
            if op == "not_in":
                return ~c.isin(list(value)) if value else F.lit(True)
            if op == "range":
                return condition(c, tuple(value))
        if len(spec) == 2 and _scalar(head) and _scalar(spec[1]):
            low, high = spec
            if low is None and high is None:
                raise ValueError("a range needs a bound")
            parts = [c >= low] * (low is not None) + [c <= high] * (high is not None)
            return reduce(Column.__and__, parts)
        raise ValueError(f"no condition: {spec!r}")
    return c == spec


def predicate(df: DataFrame, expr=None, **by_column) -> Column:
    """All of: a Column, an SQL string, a dict or a callable on df, and the conditions given by column."""
    parts: list[Column] = []
    if isinstance(expr, dict):
        by_column = expr | by_column
    elif isinstance(expr, str):
        parts.append(F.expr(expr))
    elif isinstance(expr, Column):
        parts.append(expr)
    elif callable(expr):
        parts.append(expr(df))
    elif expr is not None:
        raise TypeError(f"no predicate: {expr!r}")
    parts += [condition(c, v) for c, v in by_column.items()]
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def normalize_filters(filters: dict | None) -> list[tuple]:
    """The filter dict as (column, op, value), with half-open ranges as comparisons."""
    out = []
    for name, spec in (filters or {}).items():
        if isinstance(spec, (list, set)):
            out.append((name, "in", list(spec)))
        elif isinstance(spec, tuple):
            if len(spec) != 2:
                raise ValueError(f"{name}: a pair is needed")
            head, value = spec
            if isinstance(head, str) and ALIASES.get(head, head) in COMPARE:
                out.append((name, ALIASES.get(head, head), value))
            elif head is None and value is None:
                raise ValueError(f"{name}: a range needs a bound")
            elif value is None:
                out.append((name, ">=", head))
            elif head is None:
                out.append((name, "<=", value))
            else:
                out.append((name, "range", (head, value)))
        elif isinstance(spec, dict):
            raise ValueError(f"{name}: no condition")
        else:
            out.append((name, "==", spec))
    return out


def from_normalized(filters: list[tuple]) -> Column:
    """The exact condition of normalised filters."""
    parts = [condition(c, list(v) if op == "in" else tuple(v) if op == "range" else (op, v)) for c, op, v in filters]
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def may_hold(filters: list[tuple], low, high, nulls, rows) -> Column:
    """Whether a chunk with these statistics can hold a row that passes; low, high, nulls, rows: functions from a
    column's name to a Column, or None where the chunk has no statistics of it. Never false for a chunk with matches."""
    parts = [F.lit(True)]
    for name, op, v in filters:
        lo, hi = low(name), high(name)
        if lo is None or hi is None:
            continue
        if op == "==":
            keep = (lo <= v) & (hi >= v)
        elif op == "in":
            keep = reduce(Column.__or__, [(lo <= x) & (hi >= x) for x in v], F.lit(False))
        elif op in (">", ">="):
            keep = COMPARE[op](hi, v)
        elif op in ("<", "<="):
            keep = COMPARE[op](lo, v)
        elif op == "range":
            keep = (hi >= v[0]) & (lo <= v[1])
        else:
            keep = ~((lo == v) & (hi == v) & (nulls(name) == 0))
        parts.append(F.coalesce(keep, nulls(name) < rows(name)))
    return reduce(Column.__and__, parts)
