"""The expression language: parser, compiler to columns, function library."""

from .compiler import compile_expression
from .parser import parse

__all__ = ["compile_expression", "parse"]
