"""Formula text to a Catalyst column.

Python reads the text (``ast.parse``); each allowed element is mapped to the Column expression of
the same meaning. Nothing is evaluated in Python per row.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from difflib import get_close_matches
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulane.functions import scalars as S

# Names and limits users of the formula language rely on.
CONSTANTS = {"PI": 3.14159265358979, "E": 2.71828182845904, "TRUE": True, "FALSE": False}
MAX_CHARS = 1000
MAX_NODES = 200  # of a formula of a step; derived and generated columns have no such limit

# Kind of an expression: "int", "num", "bool", "str", "null" or "other".
NUMERIC = ("int", "num", "bool")


class FormulaError(ValueError):
    """The text is not a formula this library accepts."""


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str

    def number(self) -> Column:
        if self.kind in ("str", "other"):
            raise FormulaError("a number is needed where the formula has text")
        return self.col if self.kind in ("int", "num") else self.col.cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "str":
            return self.col != ""
        return self.number() != 0


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    return "other"


def column_of(field: T.StructField) -> Typed:
    """A table column as the formula sees it: long, double without NaN, or unchanged."""
    kind, col = kind_of(field.dataType), F.col(f"`{field.name}`")
    if kind == "int":
        col = col.cast("long")
    elif kind == "num":
        col = S.missing_as_null(col.cast("double")) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else col.cast("double")
    return Typed(col, kind)


def _parse(text: str, max_chars: int, max_nodes: int | None = None) -> ast.Expression:
    if len(text) > max_chars:
        raise FormulaError(f"formula longer than {max_chars} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as err:
        raise FormulaError(f"not a formula: {err}") from err
    if max_nodes is not None and sum(1 for _ in ast.walk(tree)) > max_nodes:
        raise FormulaError(f"formula has more than {max_nodes} elements")
    return tree


def _is_alias(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "node"


def referenced_names(text: str, aliases: dict[str, str] | None = None) -> list[str]:
    """Names a formula reads, sorted; function names are not among them."""
    names, called = set(), set()
    for node in ast.walk(_parse(text, MAX_CHARS)):
        if isinstance(node, ast.Call):
            called.add(id(node.func))
            if _is_alias(node) and node.args and isinstance(node.args[0], ast.Constant):
                names.add((aliases or {}).get(node.args[0].value, node.args[0].value))
        elif isinstance(node, ast.Name) and id(node) not in called:
            names.add(node.id)
    return sorted(names)


def formula(
    text: str,
    df: DataFrame,
    context: dict[str, Any] | None = None,
    aliases: dict[str, str] | None = None,
    strict: bool = False,
    max_chars: int = MAX_CHARS,
    max_nodes: int | None = MAX_NODES,
) -> Column:
    """Column for `text` over the columns of `df`; `context` holds constants and lookup tables."""
    return typed_formula(text, df, context, aliases, strict, max_chars, max_nodes).col


def typed_formula(text, df, context=None, aliases=None, strict=False, max_chars=MAX_CHARS, max_nodes=MAX_NODES) -> Typed:
    fields = {f.name: f for f in df.schema.fields}
    return _Builder(fields, context or {}, aliases or {}, strict).build(_parse(text, max_chars, max_nodes).body)


BIND_DEPTH = 2  # operands nested deeper than this are bound; shallow ones stay in generated code
REPEATING = ("min", "max", "clip", "clamp", "floor", "ceil", "sqrt", "log", "log10", "isnan")


def _repeated_operands(node: ast.AST) -> list[ast.AST]:
    """The operands that the Column of `node` names more than once, all of them always computed."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.FloorDiv, ast.Div)):
        return [node.left, node.right]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in REPEATING:
        return node.args
    if isinstance(node, ast.Compare) and len(node.ops) > 1:
        return node.comparators[:-1]
    return []


class _Builder:
    def __init__(self, fields, context, aliases, strict):
        self.fields, self.context, self.aliases, self.strict = fields, context, aliases, strict
        self.bound: dict[ast.AST, Typed] = {}
        self.depths: dict[ast.AST, int] = {}

    def build(self, node: ast.AST) -> Typed:
        if node in self.bound:
            return self.bound[node]
        handler = getattr(self, f"on_{type(node).__name__}", None)
        if handler is None:
            raise FormulaError(f"not allowed in a formula: {type(node).__name__}")
        heavy = [o for o in _repeated_operands(node) if o not in self.bound and self.depth(o) >= BIND_DEPTH]
        return self.bind(handler, node, heavy) if heavy else handler(node)

    def depth(self, node: ast.AST) -> int:
        """How many operators that name an operand several times lie within each other."""
        if node not in self.depths:
            below = max((self.depth(c) for c in ast.iter_child_nodes(node)), default=0)
            self.depths[node] = below + bool(_repeated_operands(node))
        return self.depths[node]

    def bind(self, handler, node: ast.AST, heavy: list[ast.AST]) -> Typed:
        """`node` over variables that hold its heavy operands, so that each is computed once and the formula's Column grows with its text only."""
        operands, kind = [self.build(o) for o in heavy], None

        def body(row: Column) -> Column:
            nonlocal kind
            self.bound.update({o: Typed(row[f"x{i}"], t.kind) for i, (o, t) in enumerate(zip(heavy, operands))})
            result = handler(node)
            for o in heavy:
                del self.bound[o]
            kind = result.kind
            return result.col

        held = F.array(F.struct(*[t.col.alias(f"x{i}") for i, t in enumerate(operands)]))
        return Typed(F.get(F.transform(held, body), F.lit(0)), kind)

    # names and literals -------------------------------------------------------------------

    def literal(self, value: Any) -> Typed:
        if isinstance(value, bool):
            return Typed(F.lit(value), "bool")
        if isinstance(value, int):
            return Typed(F.lit(value).cast("long"), "int")
        if isinstance(value, float):
            return Typed(F.lit(value), "num")
        if isinstance(value, str):
            return Typed(F.lit(value), "str")
        if value is None:
            return Typed(F.lit(None), "null")
        raise FormulaError(f"not usable in a formula: {type(value).__name__}")

    def on_Constant(self, node):
        return self.literal(node.value)

    def name(self, name: str) -> Typed:
        if name in self.fields:
            return column_of(self.fields[name])
        if name in CONSTANTS:
            return self.literal(CONSTANTS[name])
        if name in self.context:
            return self.literal(self.context[name])
        close = get_close_matches(name, list(self.fields) + list(self.context), n=3)
        advice = f"; closest: {', '.join(close)}" if close else ""
        raise FormulaError(f"the formula uses '{name}', which is no column, constant or context entry{advice}")

    def on_Name(self, node):
        return self.name(node.id)

    def on_Subscript(self, node):
        """`table[key]`: a strict lookup in a table of the context."""
        if not isinstance(node.value, ast.Name) or not isinstance(self.context.get(node.value.id), dict):
            raise FormulaError("only lookup tables of the context can be indexed")
        from tabulane.operators.lookup import map_column

        key, table = self.build(node.slice), self.context[node.value.id]
        col = map_column(S.as_key(key.col, key.kind == "bool"), table, on_missing="error", name=node.value.id)
        return Typed(col, "str" if any(isinstance(v, str) for v in table.values()) else "num")

    # operators ----------------------------------------------------------------------------

    def on_UnaryOp(self, node):
        x = self.build(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~x.truth(), "bool")
        if isinstance(node.op, ast.Invert):
            return Typed(F.bitwise_not(self.whole(x)), "int")
        kind = "int" if x.kind == "int" else "num"
        return Typed(-x.number() if isinstance(node.op, ast.USub) else x.number(), kind)

    def whole(self, x: Typed) -> Column:
        if x.kind not in ("int", "bool"):
            raise FormulaError("bit operators need whole numbers")
        return x.col.cast("long")

    def on_BinOp(self, node):
        a, b, op = self.build(node.left), self.build(node.right), type(node.op)
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            if a.kind == b.kind == "bool":
                pair = {ast.BitAnd: a.col & b.col, ast.BitOr: a.col | b.col, ast.BitXor: a.col != b.col}
                return Typed(pair[op], "bool")
            x, y = self.whole(a), self.whole(b)
            pair = {ast.BitAnd: x.bitwiseAND(y), ast.BitOr: x.bitwiseOR(y), ast.BitXor: x.bitwiseXOR(y)}
            return Typed(pair[op], "int")
        if op in (ast.LShift, ast.RShift):
            call = "shiftleft" if op is ast.LShift else "shiftright"
            return Typed(F.call_function(call, self.whole(a), self.whole(b).cast("int")), "int")
        if op is ast.Add and a.kind == b.kind == "str":
            return Typed(F.concat(a.col, b.col), "str")
        x, y = a.number(), b.number()
        kind = "int" if a.kind == b.kind == "int" else "num"
        if op is ast.Add:
            return Typed(x + y, kind)
        if op is ast.Sub:
            return Typed(x - y, kind)
        if op is ast.Mult:
            return Typed(x * y, kind)
        if op is ast.Div:
            return Typed(S.divide(x, y, self.strict), "num")
        if op is ast.FloorDiv:
            return Typed(S.floor_divide(x, y, self.strict), "num")
        if op is ast.Mod:
            return Typed(S.modulo(x, y, self.strict), kind)
        if op is ast.Pow:
            return Typed(F.pow(x.cast("double"), y.cast("double")), "num")
        raise FormulaError(f"not allowed in a formula: {op.__name__}")

    def compare(self, a: Typed, op: ast.cmpop, b: Typed) -> Column:
        if a.kind in NUMERIC and b.kind in NUMERIC:
            x, y = (a.col, b.col) if a.kind == b.kind else (a.number(), b.number())
        elif a.kind == b.kind or "null" in (a.kind, b.kind):
            x, y = a.col, b.col
        elif isinstance(op, (ast.Eq, ast.NotEq)):
            return F.lit(isinstance(op, ast.NotEq))
        else:
            raise FormulaError("numbers and text cannot be ordered")
        if isinstance(op, ast.Eq):
            return x == y
        if isinstance(op, ast.NotEq):
            return x != y
        if isinstance(op, ast.Lt):
            return x < y
        if isinstance(op, ast.LtE):
            return x <= y
        if isinstance(op, ast.Gt):
            return x > y
        if isinstance(op, ast.GtE):
            return x >= y
        raise FormulaError(f"not allowed in a formula: {type(op).__name__}")

    def on_Compare(self, node):
        left, result = self.build(node.left), None
        for op, right_node in zip(node.ops, node.comparators):
            right = self.build(right_node)
            link = self.compare(left, op, right)
            result = link if result is None else result & link
            left = right
        return Typed(result, "bool")

    def unify(self, a: Typed, b: Typed) -> tuple[Column, Column, str]:
        """Both branches of a choice in one type."""
        if a.kind == b.kind:
            return a.col, b.col, a.kind
        if "null" in (a.kind, b.kind):
            return a.col, b.col, b.kind if a.kind == "null" else a.kind
        return a.number().cast("double"), b.number().cast("double"), "num"

    def on_BoolOp(self, node):
        """Like the language's `and`/`or`: the operand that decides is the value. One CASE with a branch per operand, so long chains stay
        as long as they are written."""
        parts, either = [self.build(v) for v in node.values], isinstance(node.op, ast.Or)
        if all(p.kind == "bool" for p in parts):
            join = (lambda a, b: a | b) if either else (lambda a, b: a & b)
            return Typed(reduce(join, [p.col for p in parts]), "bool")
        common = parts[0]
        for part in parts[1:]:
            _, y, kind = self.unify(common, part)
            common = Typed(y, kind)
        values = [self.unify(p, common)[0] for p in parts]
        case = None
        for part, value in zip(parts[:-1], values[:-1]):
            truth = F.coalesce(part.truth(), F.lit(False))
            stop = truth if either else ~truth
            case = F.when(stop, value) if case is None else case.when(stop, value)
        return Typed(case.otherwise(values[-1]), common.kind)

    def on_IfExp(self, node):
        return self.choice(self.build(node.test), self.build(node.body), self.build(node.orelse))

    def choice(self, test: Typed, body: Typed, other: Typed) -> Typed:
        x, y, kind = self.unify(body, other)
        return Typed(S.choose(test.truth(), x, y), kind)

    # functions ----------------------------------------------------------------------------

    def on_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("only plain function calls are allowed")
        fn = node.func.id
        if fn == "node":
            if len(node.args) != 1 or not isinstance(node.args[0], ast.Constant) or not isinstance(node.args[0].value, str):
                raise FormulaError('node() takes one quoted name')
            return self.name(self.aliases.get(node.args[0].value, node.args[0].value))
        low, high = ARITY.get(fn, (None, None))
        if low is None:
            raise FormulaError(f"function not allowed: {fn}")
        if not low <= len(node.args) <= high:
            raise FormulaError(f"{fn} takes {low}{'' if low == high else f' to {high}'} arguments")
        args = [self.build(a) for a in node.args]
        if fn in ("where", "if_else"):
            return self.choice(*args)
        if fn == "coalesce":
            x, y, kind = self.unify(*args)
            return Typed(F.coalesce(x, y), kind)
        if fn == "isnull":
            return Typed(args[0].col.isNull(), "bool")
        if fn == "round":
            digits = 0
            if len(node.args) == 2:
                if not isinstance(node.args[1], (ast.Constant, ast.UnaryOp)):
                    raise FormulaError("round takes a literal number of digits")
                digits = int(ast.literal_eval(node.args[1]))
            return Typed(S.round_half_even(args[0].number().cast("double"), digits), "num")
        nums = [a.number() for a in args]
        if fn == "abs":
            return Typed(F.abs(nums[0]), "int" if args[0].kind == "int" else "num")
        if fn in ("min", "max", "clip", "clamp"):
            kind = "int" if all(a.kind == "int" for a in args) else "num"
            nums = nums if kind == "int" else [n.cast("double") for n in nums]
            call = {"min": S.smallest, "max": S.largest}.get(fn, S.clip)
            return Typed(call(*nums), kind)
        nums = [n.cast("double") for n in nums]
        if fn == "isnan":
            return Typed(S.is_missing(nums[0]), "bool")
        if fn == "sqrt":
            return Typed(S.sqrt(nums[0], self.strict), "num")
        if fn == "log":
            return Typed(S.log(*nums, strict=self.strict), "num")
        if fn == "log10":
            return Typed(S.log10(nums[0], self.strict), "num")
        if fn == "floor":
            return Typed(S.floor(nums[0]), "num")
        if fn == "ceil":
            return Typed(S.ceil(nums[0]), "num")
        return Typed(getattr(F, fn)(*nums), "num")  # exp, pow, sin, cos, tan


# The functions of the formula language with their argument counts.
ARITY = {
    "abs": (1, 1),
    "min": (2, MAX_CHARS),
    "max": (2, MAX_CHARS),
    "round": (1, 2),
    "floor": (1, 1),
    "ceil": (1, 1),
    "sqrt": (1, 1),
    "log": (1, 2),
    "log10": (1, 1),
    "exp": (1, 1),
    "pow": (2, 2),
    "sin": (1, 1),
    "cos": (1, 1),
    "tan": (1, 1),
    "clip": (3, 3),
    "clamp": (3, 3),
    "where": (3, 3),
    "if_else": (3, 3),
    "isnan": (1, 1),
    "isnull": (1, 1),
    "coalesce": (2, 2),
}
