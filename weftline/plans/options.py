"""Choices where a dynamically typed evaluator and SQL disagree."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """SQL by default.

    filter_grouping: "and", or "or_same_value": filters of one operator and
    value are alternatives. null_safe: = treats nulls as equal. empty_as_zero:
    sums and averages of nothing are 0. numeric_strings: texts sort as numbers
    where they are numbers. script: functions and CONCAT print nulls as text.
    lenient: errors in projections give null. strict_single: a value reference
    must hold exactly one value.
    """

    filter_grouping: str = "and"
    null_safe: bool = False
    empty_as_zero: bool = False
    numeric_strings: bool = False
    script: bool = False
    lenient: bool = False
    strict_single: bool = False


DEFAULT = Options()
