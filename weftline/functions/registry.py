"""Registry of scalar functions, each a builder of a Column.

``standard`` gives SQL results, ``script`` those of a dynamically typed
evaluator: nulls print as text, rounding goes up at ties, dates are text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FunctionNotFound(LookupError):
    def __init__(self, name: str):
        super().__init__(f"Function not found: {name}")


@dataclass(frozen=True)
class Function:
    """``build(args, script)`` gives the Column; at least ``least`` arguments, at most ``most``."""

    name: str
    build: Callable[[list[Column], bool], Column]
    least: int = 1
    most: int | None = 1

    def validate(self, n: int) -> None:
        if n < self.least or (self.most is not None and n > self.most):
            want = str(self.least) if self.least == self.most else f"{self.least} to {self.most if self.most is not None else 'any'}"
            raise ValueError(f"{self.name} takes {want} arguments, got {n}")


class FunctionRegistry:
    """Functions by exact name. A name can be registered once."""

    def __init__(self, functions: list[Function] | None = None):
        self._by_name: dict[str, Function] = {}
        for f in functions or []:
            self.register(f)

    def register(self, function: Function) -> None:
        if function.name in self._by_name:
            raise ValueError(f"Function already registered: {function.name}")
        self._by_name[function.name] = function

    def register_callable(self, name: str, fn: Callable, return_type: str, vectorized: bool = True, args: int = 1) -> None:
        """A Python function: of pandas Series by default, of values otherwise."""
        udf = (F.pandas_udf if vectorized else F.udf)(fn, return_type)
        self.register(Function(name, lambda a, _: udf(*a), args, args))

    def get(self, name: str) -> Function:
        if name not in self._by_name:
            raise FunctionNotFound(name)
        return self._by_name[name]

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def call(self, name: str, args: list[Column], script: bool = False) -> Column:
        f = self.get(name)
        f.validate(len(args))
        return f.build(args, script)


def _round(args: list[Column], script: bool) -> Column:
    if not script:
        return F.expr("1") if not args else (F.round(args[0]) if len(args) == 1 else F.call_function("round", *args))
    scale = F.pow(F.lit(10.0), args[1]) if len(args) > 1 else F.lit(1.0)
    return F.floor(args[0].cast("double") * scale + 0.5).cast("double") / scale


def _text(args: list[Column], script: bool) -> list[Column]:
    return [F.coalesce(a.cast("string"), F.lit("null")) for a in args] if script else [a.cast("string") for a in args]


def _date_trunc(args: list[Column], script: bool) -> Column:
    unit, at = args
    if not script:
        return F.call_function("date_trunc", unit, at)
    # Text of the unit's width; other units keep the whole time stamp.
    ts = at.cast("timestamp")
    pick = F.lower(unit)
    return (
        F.when(pick == "day", F.date_format(ts, "yyyy-MM-dd"))
        .when(pick == "month", F.date_format(ts, "yyyy-MM"))
        .when(pick == "year", F.date_format(ts, "yyyy"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )


def builtins() -> FunctionRegistry:
    """A new registry with the built-in functions."""
    one = lambda f: lambda a, _: f(a[0])
    return FunctionRegistry(
        [
            Function("ABS", one(F.abs)),
            Function("FLOOR", one(F.floor)),
            Function("CEIL", one(F.ceil)),
            Function("ROUND", _round, 1, 2),
            Function("SQRT", one(F.sqrt)),
            Function("UPPER", lambda a, s: F.upper(_text(a, s)[0])),
            Function("LOWER", lambda a, s: F.lower(_text(a, s)[0])),
            # All white space, where Spark's trim takes blanks only.
            Function("TRIM", lambda a, s: F.regexp_replace(_text(a, s)[0], r"(?U)^\s+|\s+$", "")),
            Function("LENGTH", lambda a, s: F.length(_text(a, s)[0])),
            Function("CONCAT", lambda a, s: F.concat(*_text(a, s)), 2, None),
            Function("COALESCE", lambda a, _: F.coalesce(*a), 2, None),
            Function("NOW", lambda a, s: F.unix_millis(F.current_timestamp()) if s else F.current_timestamp(), 0, 0),
            Function("DATE_TRUNC", _date_trunc, 2, 2),
        ]
    )
