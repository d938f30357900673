"""A safe expression language, turned into Columns: comparisons, and/or/not, arithmetic, names, subscripts and get()."""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column, functions as F

MAX_LENGTH, MAX_DEPTH = 1_000, 20
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class ExpressionError(ValueError):
    """The text is no allowed expression."""


def condition(text: str, names: set[str]) -> Column:
    """Column of an expression over the columns in ``names``. and/or give booleans; nulls follow SQL. Anything but the listed
    forms, unknown names, and texts too long or too deep raise ExpressionError."""
    if len(text) > MAX_LENGTH:
        raise ExpressionError("too long")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ExpressionError(str(e)) from None

    def walk(node: ast.AST, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise ExpressionError("too deep")
        go = lambda n: walk(n, depth + 1)
        match node:
            case ast.BoolOp(op, values):
                return reduce(operator.and_ if isinstance(op, ast.And) else operator.or_, map(go, values))
            case ast.UnaryOp(ast.Not(), value):
                return ~go(value)
            case ast.UnaryOp(ast.USub(), value):
                return -go(value)
            case ast.BinOp(left, op, right) if type(op) in _BINARY:
                return _BINARY[type(op)](go(left), go(right))
            case ast.Compare(left, ops, rights):
                sides, out = [left, *rights], []
                for a, op, b in zip(sides, ops, sides[1:]):
                    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
                        hit = go(a).isin([_constant(x) for x in b.elts])
                        out.append(~hit if isinstance(op, ast.NotIn) else hit)
                    elif type(op) in _COMPARE:
                        out.append(_COMPARE[type(op)](go(a), go(b)))
                    else:
                        raise ExpressionError("comparison not allowed")
                return reduce(operator.and_, out)
            case ast.Constant():
                return F.lit(_constant(node))
            case ast.Name(name):
                if name not in names:
                    raise ExpressionError(f"unknown name {name}")
                return F.col(f"`{name}`")
            case ast.Subscript(value, ast.Constant(key)) if isinstance(key, (str, int)):
                return go(value)[key]
            case ast.Call(ast.Attribute(value, "get"), [ast.Constant(key), *rest], []) if len(rest) < 2:
                found = go(value)[key]
                return F.coalesce(found, go(rest[0])) if rest else found
        raise ExpressionError(f"{type(node).__name__} not allowed")

    return walk(tree, 0)


def _constant(node: ast.AST) -> object:
    if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float, bool, type(None))):
        return node.value
    raise ExpressionError("constant not allowed")
