"""Formulas over bands as columns: parsed, not rewritten as text."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, Callable] = {
    "sqrt": F.sqrt, "ln": F.ln, "log": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "atan2": F.atan2, "arctan2": F.atan2,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "abs": F.abs, "pow": F.pow, "least": F.least, "greatest": F.greatest, "floor": F.floor, "ceil": F.ceil, "where": lambda c, a, b: F.when(c, a).when(~c, b),
}
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def formula(text: str, band: Callable[[str], Column | None]) -> Column:
    """The column of a formula: numbers, names of bands, ``+ - * / % **``, comparisons, ``and or not``, ``a if c else b`` and a few functions.

    ``band`` gives the column of a name, None for a name that isn't known. ``^`` is a
    power, ``&``, ``|`` and ``~`` combine conditions. A null makes the result null, and so
    does a division by zero, wherever it stands in the formula; what has no real value
    (the root of a negative number) is NaN.
    """
    try:
        tree = ast.parse(text.strip().replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text}") from e

    def build(n: ast.AST) -> Column:
        match n:
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(v if isinstance(v, bool) else float(v))
            case ast.Name(id=name):
                if (c := band(name)) is None:
                    raise ValueError(f"not allowed in an equation: {name}")
                return c
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~build(x)
            case ast.BinOp(left=a, op=op, right=b):
                x, y = build(a), build(b)
                match op:
                    case ast.Add():
                        return x + y
                    case ast.Sub():
                        return x - y
                    case ast.Mult():
                        return x * y
                    case ast.Div():
                        return F.try_divide(x, y)
                    case ast.Mod():
                        return F.pmod(x, F.when(y != 0, y))
                    case ast.Pow():
                        return F.when((x != 0) | (y >= 0), F.pow(x, y))  # a power of zero that divides by it
                    case ast.BitAnd():
                        return x & y
                    case ast.BitOr():
                        return x | y
            case ast.BoolOp(op=op, values=values):
                out = build(values[0])
                for v in values[1:]:
                    out = out & build(v) if isinstance(op, ast.And) else out | build(v)
                return out
            case ast.Compare(left=a, ops=ops, comparators=others) if all(type(o) in _COMPARE for o in ops):
                out, x = None, build(a)
                for o, b in zip(ops, others, strict=True):
                    y = build(b)
                    part = getattr(x, _COMPARE[type(o)])(y)
                    out, x = part if out is None else out & part, y
                return out
            case ast.IfExp(test=c, body=a, orelse=b):
                return _FUNCTIONS["where"](build(c), build(a), build(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name.lower() in _FUNCTIONS:
                try:
                    return _FUNCTIONS[name.lower()](*map(build, args))
                except TypeError as e:
                    raise ValueError(f"{name} takes other arguments") from e
        raise ValueError(f"not allowed in an equation: {ast.unparse(n)}")

    return build(tree)
