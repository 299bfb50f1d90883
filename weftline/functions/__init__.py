"""Scalar functions of the expression language and JSON helpers."""

from weftline.functions.registry import FunctionNotFound, FunctionRegistry, builtins

__all__ = ["FunctionNotFound", "FunctionRegistry", "builtins"]
