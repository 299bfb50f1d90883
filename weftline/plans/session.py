"""The session's cursor: what the last result was, for "those rows"."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IDS = 50
TTL_SECONDS = 300
#: Words that point at the last result.
REFERENTIAL = re.compile(r"\b(those|these|them|this|that|they|it|the same|previous|above|the (?:records?|rows?|results?|entr(?:y|ies)|items?)|last (?:result|query|ones?))\b", re.I)


def is_referential(text: str) -> bool:
    return bool(REFERENTIAL.search(text))


class SessionCursor:
    """Ids of up to ``MAX_IDS`` rows, else the filters that made the result."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.clear()

    def clear(self) -> None:
        self.table = self.key = None
        self.ids: list | None = None
        self.filters: list[Mapping] = []
        self.at = float("-inf")

    def remember(self, table: str, rows: DataFrame, filters: list[Mapping] | None = None, key: str = "id") -> None:
        self.table, self.key, self.filters, self.at = table, key, list(filters or []), self.clock()
        found = [r[0] for r in rows.select(key).limit(MAX_IDS + 1).collect()]  # bounded
        self.ids = found if len(found) <= MAX_IDS else None

    @property
    def active(self) -> bool:
        return self.table is not None and self.clock() - self.at <= TTL_SECONDS

    def where(self) -> Column:
        """The rows as a condition; raises where there is none."""
        if not self.active:
            raise LookupError("the session has no current result")
        if self.ids is not None:
            if not self.ids:
                raise LookupError("the last result is empty")
            return F.col(self.key).isin(self.ids)
        out = None
        for f in self.filters:
            c = filter_column(f)
            if c is not None:
                out = c if out is None else out & c
        if out is None:
            raise LookupError("the last result has no filters")
        return out


def filter_column(f: Mapping) -> Column | None:
    """One stored filter; unknown operators give None."""
    c, how, v = F.col(f"`{f['field']}`"), f["operator"], f.get("value")
    if how == "IS NULL":
        return c.isNull()
    if how == "IS NOT NULL":
        return c.isNotNull()
    if how == "LIKE":
        return c.ilike(v)
    if how in ("IN", "NOT IN"):
        values = list(v) if isinstance(v, (list, tuple)) else [v]
        return c.isin(values) if how == "IN" else ~c.isin(values)
    if how == "BETWEEN":
        return c.between(v[0], v[1])
    if how == "=":
        if v is None:
            return c.isNull()
        return F.lower(c) == v.lower() if f.get("caseInsensitive") and isinstance(v, str) else c == F.lit(v)
    if how in ("!=", "<", ">", "<=", ">="):
        return {"!=": c != F.lit(v), "<": c < F.lit(v), ">": c > F.lit(v), "<=": c <= F.lit(v), ">=": c >= F.lit(v)}[how]
    return None
