"""Column types of programs, constants, and casts with range checks."""

from __future__ import annotations

import ast
import math
import operator
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.lang.errors import UnknownName

#: Type names and the Spark types that hold them. Unsigned types get the next wider signed one.
BUILTIN: dict[str, str] = {
    "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "bigint", "usize": "bigint",
    "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "isize": "bigint",
    "bool": "boolean", "String": "string", "f32": "float", "f64": "double",
    "Date": "date", "Timestamp": "timestamp_ntz", "Bytes": "binary", "U64": "decimal(20,0)",
}
_RANGES = {f"{s}{n}": ((0, 2**n - 1) if s == "u" else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)) for s in "ui" for n in (8, 16, 32, 64)}
_RANGES |= {"usize": _RANGES["u64"], "isize": _RANGES["i64"]}
_HELD = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _divided(a: Any, b: Any) -> Any:
    """Division; of integers, truncated toward zero."""
    if isinstance(a, float) or isinstance(b, float):
        return a / b
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _left_over(a: Any, b: Any) -> Any:
    """The remainder of the division, with the sign of the first number."""
    return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else a - b * _divided(a, b)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: _divided, ast.Mod: _left_over, ast.USub: operator.neg, ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor}


class Types:
    """Known type names; ``extra`` maps further names to Spark type strings."""

    def __init__(self, extra: dict[str, str] | None = None):
        self.names = BUILTIN | (extra or {})

    def spark(self, name: str) -> str:
        if name not in self.names:
            raise UnknownName(f"type {name} is not registered")
        kind = self.names[name]
        if "map<" in kind.lower():
            raise UnknownName(f"type {name}: maps cannot be compared")
        return kind

    def checked(self, column: Column, name: str) -> Column:
        """The column cast to a type; a value out of an unsigned type's range is an error. -0.0 becomes 0.0."""
        out = column.cast(self.spark(name))
        if name in ("u8", "u16", "u32", "u64", "usize") and self.names[name] == BUILTIN[name]:
            low, high = 0, min(_RANGES[name][1], 2**63 - 1)
            problem = F.raise_error(F.concat(F.lit(f"value out of range of {name}: "), out.cast("string"))).cast(self.spark(name))
            return F.when((out < low) | (out > high), problem).otherwise(out)
        return out + F.lit(0.0).cast(self.spark(name)) if self.spark(name) in ("float", "double") else out

    def literal(self, value: Any, name: str) -> Column | None:
        """A constant of a type, or None if no value of the type equals it."""
        kind = self.spark(name)
        if isinstance(value, bool) or not isinstance(value, int):
            return F.lit(value).cast(kind) if not isinstance(value, (list, tuple)) else F.array(*[F.lit(v) for v in value]).cast(kind)
        bits = _HELD.get(kind)
        return None if bits and not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1) else F.lit(value).cast(kind)


_PARTS = re.compile(r"""(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*(?:::\w+)+)|[A-Za-z_]\w*|(?P<number>\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?|\.(?!\w))?)(?P<kind>[ui](?:8|16|32|64|size)|f32|f64)?""")


def constant(text: str, known: dict[str, Any]) -> Any:
    """The value of a constant: a registered name, a type's MAX or MIN, or arithmetic on numbers, strings and names."""
    if text in known:
        return known[text]
    m = re.fullmatch(r"(?:::)?(?:std::|core::)?(\w+)::(MAX|MIN)", text)
    if m and m[1] in _RANGES:
        return _RANGES[m[1]][m[2] == "MAX"]

    def value(node: ast.AST) -> Any:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id in ("true", "false"):
                return node.id == "true"
            if node.id in names:
                return known[names[node.id]]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, (ast.List, ast.Tuple)):
            return [value(x) for x in node.elts]
        raise UnknownName(f"constant {text} is not registered")

    names = {k.replace(":", "_"): k for k in known}

    def plainly(m: re.Match) -> str:
        """Numbers lose their type's suffix and names their colons; quoted text stays as it is."""
        if m["number"]:
            return m["number"].replace("_", "") + (".0" if (m["kind"] or "").startswith("f") and "." not in m["number"] else "")
        return m[0].replace(":", "_") if m["name"] else m[0]

    plain = _PARTS.sub(plainly, text)
    try:
        return value(ast.parse(plain.strip(), mode="eval"))
    except (SyntaxError, ZeroDivisionError):
        raise UnknownName(f"constant {text} is not registered") from None


def struct_type(fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in fields])
