"""Dotted paths over nested columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Test = Callable[[Column, T.DataType], Column]


def quoted(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path, arrays on the way entered; None where the schema has no such path."""
    kind: T.DataType = schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if part.isdigit():
                break
        else:
            if isinstance(kind, T.StructType) and part in kind.names:
                kind = kind[part].dataType
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            else:
                return None
    return kind


def value_at(schema: T.StructType, path: str) -> Column:
    """The value at a path: null where the schema lacks it; through an array of structs, an array of the fields."""
    parts = path.split(".")
    if parts[0] not in schema.names:
        return F.lit(None)
    column, kind = quoted(parts[0]), schema[parts[0]].dataType
    for part in parts[1:]:
        if isinstance(kind, T.StructType) and part in kind.names:
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, int(part)), kind.elementType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and part in kind.elementType.names:
            column, kind = column.getField(part), T.ArrayType(kind.elementType[part].dataType)
        else:
            return F.lit(None)
    return column


def any_at(schema: T.StructType, path: str, test: Test) -> Column:
    """Whether test holds for the value at a path, or for an element of an array on the way or at its end. As test is never null, neither is this."""
    parts = path.split(".")

    def walk(column: Column, kind: T.DataType, rest: list[str]) -> Column:
        if not rest:
            if isinstance(kind, T.ArrayType):
                return test(column, kind) | (column.isNotNull() & F.exists(column, lambda x: test(x, kind.elementType)))
            return test(column, kind)
        head, tail = rest[0], rest[1:]
        if isinstance(kind, T.StructType) and head in kind.names:
            return walk(column.getField(head), kind[head].dataType, tail)
        if isinstance(kind, T.MapType):
            return walk(F.try_element_at(column, F.lit(head)), kind.valueType, tail)
        if isinstance(kind, T.ArrayType) and head.isdigit():
            return walk(F.get(column, int(head)), kind.elementType, tail)
        if isinstance(kind, T.ArrayType):
            return column.isNotNull() & F.exists(column, lambda x: walk(x, kind.elementType, rest))
        return test(F.lit(None), T.NullType())

    if parts[0] not in schema.names:
        return test(F.lit(None), T.NullType())
    return walk(quoted(parts[0]), schema[parts[0]].dataType, parts[1:])


def nested_value(doc: Any, path: str) -> Any:
    """The value at a path of a plain document; None where there is none."""
    for part in path.split("."):
        if isinstance(doc, (list, tuple)) and part.isdigit() and int(part) < len(doc):
            doc = doc[int(part)]
        elif isinstance(doc, dict) and part in doc:
            doc = doc[part]
        else:
            return None
    return doc


def safe_name(path: str) -> str:
    """A path as a name of letters, digits and underscores that begins with a letter."""
    name = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]", "_", path)).strip("_")
    return name if name[:1].isalpha() else f"p_{name}"
