"""Filter documents as boolean Columns that are never null.

Closed schemas can't tell an absent field from a null one: both match null, and $exists means "not
null", unless the table has a column `_present array<string>` of the paths that were given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.expressions import Scope, constant, truth
from docloom.functions.paths import any_at, value_at

PRESENT = "_present"

#: Names of types in $type, and what they are here.
TYPES: dict[str, tuple[type[T.DataType], ...]] = {
    "string": (T.StringType,),
    "double": (T.DoubleType, T.FloatType),
    "int": (T.IntegerType, T.ShortType, T.ByteType),
    "long": (T.LongType,),
    "number": (T.NumericType,),
    "bool": (T.BooleanType,),
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}


def _comparable(kind: T.DataType, value: Any) -> bool:
    """Values of different kinds never compare: a text is not above a number."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, dict):
        return isinstance(kind, T.StructType)
    if isinstance(value, (list, tuple)):
        return isinstance(kind, T.ArrayType)
    return not isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.NullType))


def _sure(c: Column, test: Column) -> Column:
    """A test that is false for a null value; in this form it reaches the scan."""
    return c.isNotNull() & test


def _equals(value: Any) -> Callable[[Column, T.DataType], Column]:
    if value is None:
        return lambda c, k: c.isNull()
    if isinstance(value, re.Pattern):
        return lambda c, k: _sure(c, c.rlike(value.pattern)) if isinstance(k, T.StringType) else F.lit(False)
    if isinstance(value, Column):
        return lambda c, k: F.coalesce(c == value, F.lit(False))
    if isinstance(value, (list, tuple)) and not value:
        return lambda c, k: _sure(c, F.size(c) == 0) if isinstance(k, T.ArrayType) else F.lit(False)
    return lambda c, k: _sure(c, c == constant(value)) if _comparable(k, value) else F.lit(False)


def _ordered(value: Any, test: Callable[[Column, Column], Column]) -> Callable[[Column, T.DataType], Column]:
    if isinstance(value, Column):
        return lambda c, k: F.coalesce(test(c, value), F.lit(False))
    return lambda c, k: _sure(c, test(c, constant(value))) if _comparable(k, value) else F.lit(False)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _in(schema: T.StructType, path: str, values: Any) -> Column:
    plain = [v for v in values if v is not None and not isinstance(v, (re.Pattern, Column, dict, list, tuple))]
    rest = [v for v in values if v is None or isinstance(v, (re.Pattern, Column, dict, list, tuple))]
    same = lambda c, k: _sure(c, c.isin([v for v in plain if _comparable(k, v)])) if any(_comparable(k, v) for v in plain) else F.lit(False)
    return _any([*([any_at(schema, path, same)] if plain else []), *(any_at(schema, path, _equals(v)) for v in rest)])


def _element(schema: T.StructType, path: str, spec: dict) -> Column:
    def test(c: Column, k: T.DataType) -> Column:
        if not isinstance(k, T.ArrayType):
            return F.lit(False)
        inner = T.StructType([T.StructField("_element", k.elementType)])
        if all(key.startswith("$") and key not in ("$and", "$or", "$nor") for key in spec):
            return F.exists(c, lambda x: _on(inner, "_element", spec, x, k.elementType))
        return F.exists(c, lambda x: _nested(k.elementType, spec, x))

    return F.coalesce(test(value_at(schema, path), _kind(schema, path)), F.lit(False))


def _kind(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for part in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return T.NullType()
        kind = kind[part].dataType
    return kind


def _on(schema: T.StructType, path: str, spec: dict, column: Column, kind: T.DataType) -> Column:
    """Operators on a value at hand."""
    return _all([_OPERATORS[op](value)(column, kind) for op, value in spec.items()])


def _nested(kind: T.DataType, spec: dict, column: Column) -> Column:
    tests = []
    for path, value in spec.items():
        own, at = column, kind
        for part in path.split("."):
            own, at = own.getField(part), at[part].dataType
        tests.append(_on(T.StructType(), path, value if _has_operators(value) else {"$eq": value}, own, at))
    return _all(tests)


_OPERATORS: dict[str, Callable[[Any], Callable[[Column, T.DataType], Column]]] = {
    "$eq": _equals,
    "$ne": lambda v: lambda c, k: ~_equals(v)(c, k),
    "$gt": lambda v: _ordered(v, lambda a, b: a > b),
    "$gte": lambda v: _ordered(v, lambda a, b: a >= b),
    "$lt": lambda v: _ordered(v, lambda a, b: a < b),
    "$lte": lambda v: _ordered(v, lambda a, b: a <= b),
    "$in": lambda v: lambda c, k: _any([_equals(x)(c, k) for x in v]),
    "$nin": lambda v: lambda c, k: ~_any([_equals(x)(c, k) for x in v]),
}


def _has_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(k, str) and k.startswith("$") for k in value)


def _field(schema: T.StructType, path: str, spec: Any, scope: Scope) -> Column:
    if not _has_operators(spec):
        return any_at(schema, path, _equals(spec))
    tests = []
    for op, value in spec.items():
        if op in ("$eq", "$gt", "$gte", "$lt", "$lte"):
            tests.append(any_at(schema, path, _OPERATORS[op](value)))
        elif op == "$ne":
            tests.append(~any_at(schema, path, _equals(value)))
        elif op == "$in":
            tests.append(_in(schema, path, value))
        elif op == "$nin":
            tests.append(~_in(schema, path, value))
        elif op == "$exists":
            there = F.coalesce(F.array_contains(F.col(PRESENT), path), F.lit(False)) if PRESENT in schema.names else value_at(schema, path).isNotNull()
            tests.append(there if value else ~there)
        elif op == "$not":
            tests.append(~_field(schema, path, value, scope))
        elif op == "$regex":
            flags = spec.get("$options", "")
            pattern = (f"(?{flags})" if flags else "") + (value.pattern if isinstance(value, re.Pattern) else value)
            tests.append(any_at(schema, path, lambda c, k, p=pattern: _sure(c, c.rlike(p)) if isinstance(k, T.StringType) else F.lit(False)))
        elif op == "$options":
            continue
        elif op == "$all":
            tests += [any_at(schema, path, _equals(v)) for v in value]
        elif op == "$size":
            tests.append(F.coalesce(F.size(value_at(schema, path)) == value, F.lit(False)) if isinstance(_kind(schema, path), T.ArrayType) else F.lit(False))
        elif op == "$elemMatch":
            tests.append(_element(schema, path, value))
        elif op == "$mod":
            tests.append(any_at(schema, path, lambda c, k, v=value: F.coalesce(F.try_mod(c, F.lit(v[0])) == v[1], F.lit(False)) if isinstance(k, T.NumericType) else F.lit(False)))
        elif op == "$type":
            names = value if isinstance(value, list) else [value]
            tests.append(any_at(schema, path, lambda c, k, ns=names: _any([c.isNull() if n == "null" else c.isNotNull() & F.lit(isinstance(k, TYPES[n])) for n in ns])))
        else:
            raise ValueError(f"unknown filter operator {op}")
    return _all(tests)


def compile_filter(spec: Mapping[str, Any] | Column | None, schema: T.StructType, variables: Mapping[str, Column] | None = None) -> Column:
    """The rows that a filter document matches; a Column passes through, null counting as no match."""
    if spec is None:
        return F.lit(True)
    if isinstance(spec, Column):
        return F.coalesce(spec, F.lit(False))
    scope, tests = Scope(schema, variables), []
    for key, value in spec.items():
        if key == "$and":
            tests.append(_all([compile_filter(v, schema, variables) for v in value]))
        elif key == "$or":
            tests.append(_any([compile_filter(v, schema, variables) for v in value]))
        elif key == "$nor":
            tests.append(~_any([compile_filter(v, schema, variables) for v in value]))
        elif key == "$expr":
            tests.append(truth(value, scope))
        elif key == "$jsonSchema":
            from docloom.schema import Object

            tests.append(value.valid(schema) if isinstance(value, Object) else F.lit(True))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key}")
        else:
            tests.append(_field(schema, key, value, scope))
    return _all(tests)
