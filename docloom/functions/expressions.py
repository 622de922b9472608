"""Expression documents as Columns: "$path", "$$variable", {"$operator": arguments}, nested documents, lists and constants."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import value_at


class Scope:
    """What names mean in an expression: the row's schema and the variables around it."""

    def __init__(self, schema: T.StructType, variables: Mapping[str, Column] | None = None):
        self.schema, self.variables = schema, dict(variables or {})

    def path(self, path: str) -> Column:
        return value_at(self.schema, path)

    def variable(self, name: str) -> Column:
        head, _, rest = name.partition(".")
        if head == "ROOT":
            return self.path(rest) if rest else F.struct(*self.schema.names)
        if head == "NOW":
            return F.current_timestamp()
        if head not in self.variables:
            raise ValueError(f"unknown variable $${head}")
        return reduce(lambda c, part: c.getField(part), rest.split(".") if rest else [], self.variables[head])

    def inside(self, **more: Column) -> Scope:
        return Scope(self.schema, self.variables | more)


def is_operator(value: Any) -> bool:
    return isinstance(value, dict) and len(value) == 1 and next(iter(value)).startswith("$")


def constant(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*(constant(v).alias(k) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return F.array(*map(constant, value))
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value)


def compile_expression(value: Any, scope: Scope) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and value.startswith("$$"):
        return scope.variable(value[2:])
    if isinstance(value, str) and value.startswith("$"):
        return scope.path(value[1:])
    if is_operator(value):
        name, argument = next(iter(value.items()))
        if name in _SPECIAL:
            return _SPECIAL[name](argument, scope)
        if name not in _PLAIN:
            raise ValueError(f"unknown expression operator {name}")
        given = argument if isinstance(argument, (list, tuple)) else [argument]
        return _PLAIN[name](*(compile_expression(a, scope) for a in given))
    if isinstance(value, dict):
        return F.struct(*(compile_expression(v, scope).alias(k) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return F.array(*(compile_expression(v, scope) for v in value))
    return constant(value)


def truth(value: Any, scope: Scope) -> Column:
    """An expression as a condition: null is false."""
    return F.coalesce(compile_expression(value, scope).cast("boolean"), F.lit(False))


# A null sorts below every other value, in comparisons as in sorts.
def _gt(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, a.isNotNull() & b.isNull())


def _lt(a: Column, b: Column) -> Column:
    return _gt(b, a)


def _condition(argument: Any, scope: Scope) -> Column:
    test, yes, no = (argument["if"], argument["then"], argument["else"]) if isinstance(argument, dict) else argument
    return F.when(truth(test, scope), compile_expression(yes, scope)).otherwise(compile_expression(no, scope))


def _switch(argument: Any, scope: Scope) -> Column:
    out = compile_expression(argument.get("default"), scope)
    for branch in reversed(argument["branches"]):
        out = F.when(truth(branch["case"], scope), compile_expression(branch["then"], scope)).otherwise(out)
    return out


def _map(argument: Any, scope: Scope) -> Column:
    return F.transform(compile_expression(argument["input"], scope), lambda x: compile_expression(argument["in"], scope.inside(**{argument.get("as", "this"): x})))


def _filter(argument: Any, scope: Scope) -> Column:
    return F.filter(compile_expression(argument["input"], scope), lambda x: truth(argument["cond"], scope.inside(**{argument.get("as", "this"): x})))


def _trim(argument: Any, scope: Scope) -> Column:
    argument = argument if isinstance(argument, dict) else {"input": argument}
    text = compile_expression(argument["input"], scope)
    return F.trim(text) if "chars" not in argument else F.trim(text, compile_expression(argument["chars"], scope))


_SPECIAL: dict[str, Callable[[Any, Scope], Column]] = {
    "$literal": lambda a, s: constant(a),
    "$cond": _condition,
    "$switch": _switch,
    "$map": _map,
    "$filter": _filter,
    "$trim": _trim,
    "$and": lambda a, s: reduce(lambda x, y: x & y, (truth(v, s) for v in a), F.lit(True)),
    "$or": lambda a, s: reduce(lambda x, y: x | y, (truth(v, s) for v in a), F.lit(False)),
    "$not": lambda a, s: ~truth(a[0] if isinstance(a, (list, tuple)) else a, s),
}


def _substring(text: Column, start: Column, size: Column) -> Column:
    return F.when(size < 0, F.substr(text, start + 1)).otherwise(F.substr(text, start + 1, F.greatest(size, F.lit(0))))


def _at(items: Column, index: Column) -> Column:
    return F.get(items, F.when(index < 0, F.size(items) + index).otherwise(index).cast("int"))


def _extreme(pick: Callable, over: Callable) -> Callable:
    return lambda *xs: over(xs[0]) if len(xs) == 1 else pick(*xs)


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


_PLAIN: dict[str, Callable[..., Column]] = {
    "$eq": lambda a, b: a.eqNullSafe(b),
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": _gt,
    "$lt": _lt,
    "$gte": lambda a, b: ~_lt(a, b),
    "$lte": lambda a, b: ~_gt(a, b),
    "$cmp": lambda a, b: F.when(_gt(a, b), 1).when(_lt(a, b), -1).otherwise(0),
    "$in": lambda a, b: F.coalesce(F.array_contains(b, a), F.lit(False)),
    "$ifNull": F.coalesce,
    "$add": lambda *xs: reduce(lambda x, y: x + y, xs),
    "$subtract": lambda a, b: a - b,
    "$multiply": lambda *xs: reduce(lambda x, y: x * y, xs),
    "$divide": lambda a, b: F.try_divide(a, b),
    "$mod": lambda a, b: F.try_mod(a, b),
    "$floor": F.floor,
    "$ceil": F.ceil,
    "$abs": F.abs,
    "$sqrt": lambda a: F.sqrt(a),
    "$pow": F.pow,
    "$ln": F.ln,
    "$round": lambda a, n=None: F.bround(a, 0) if n is None else F.bround(a, n),
    "$trunc": _whole,
    "$concat": F.concat,
    "$toUpper": lambda a: F.coalesce(F.upper(a), F.lit("")),
    "$toLower": lambda a: F.coalesce(F.lower(a), F.lit("")),
    "$substr": _substring,
    "$substrCP": _substring,
    "$substrBytes": _substring,
    "$indexOfCP": lambda text, part: F.locate(part, text) - 1 if isinstance(part, str) else F.instr(text, part) - 1,
    "$strLenCP": F.length,
    "$strLenBytes": F.octet_length,
    "$split": lambda text, by: F.split(text, F.concat(F.lit("\\Q"), by, F.lit("\\E"))),
    "$size": F.size,
    "$arrayElemAt": _at,
    "$first": lambda a: F.get(a, 0),
    "$last": lambda a: F.try_element_at(a, F.lit(-1)),
    "$concatArrays": F.concat,
    "$reverseArray": F.reverse,
    "$setUnion": F.array_union,
    "$setIntersection": F.array_intersect,
    "$setDifference": F.array_except,
    "$sum": lambda *xs: F.aggregate(xs[0], F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) if len(xs) == 1 else reduce(lambda x, y: x + y, (F.coalesce(x, F.lit(0)) for x in xs)),
    "$min": _extreme(F.least, F.array_min),
    "$max": _extreme(F.greatest, F.array_max),
    "$toString": lambda a: a.cast("string"),
    "$toObjectId": lambda a: a,
    "$toInt": lambda a: a.try_cast("int"),
    "$toLong": lambda a: a.try_cast("long"),
    "$toDouble": lambda a: a.try_cast("double"),
    "$toBool": lambda a: a.try_cast("boolean"),
    "$toDate": lambda a: a.try_cast("timestamp"),
    "$year": F.year,
    "$month": F.month,
    "$dayOfMonth": F.dayofmonth,
    "$hour": F.hour,
    "$minute": F.minute,
    "$second": F.second,
}
