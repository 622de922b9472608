"""Declared document schemas: Spark types, validity predicates, JSON-schema-like dicts, flat paths and differences.

A closed schema can't tell an absent field from a null one, so `nullable` fields, which have to be present but
may be null, are not enforced as present unless the table has `_present` (see filters).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import quoted


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Index:
    """unique, insensitive (to case), a collation, seconds to live, and a filter of the rows concerned."""

    unique: bool = False
    insensitive: bool = False
    collation: Mapping[str, Any] | None = None
    expire_after: int | None = None
    where: Mapping[str, Any] | None = None


@dataclass(frozen=True)
class Node:
    checks: tuple[tuple[str, Any], ...] = ()
    index: Index | None = None

    def spark(self) -> T.DataType:
        raise NotImplementedError

    def kind(self) -> dict[str, Any]:
        raise NotImplementedError

    def test(self, c: Column) -> Column:
        """Whether a value that isn't null conforms."""
        return F.lit(True)

    def required(self) -> bool:
        return True

    def children(self) -> Iterator[tuple[str, Node]]:
        return iter(())

    def describe(self) -> dict[str, Any]:
        return {**self.kind(), **{k: (v.pattern if isinstance(v, re.Pattern) else v) for k, v in combined(self.checks).items() if not callable(v)}}

    def check(self, **limits: Any) -> Node:
        """With more constraints: length, min_value, max_value, min_length, max_length, non_empty, integer, pattern, or predicates by name; other names are refused."""
        for name, value in limits.items():
            if name not in _CHECKS and name != "non_empty" and not callable(value):
                raise SchemaError(f"unknown check {name}")
        return replace(self, checks=self.checks + tuple(limits.items()))

    def indexed(self, **options: Any) -> Node:
        return replace(self, index=Index(**options))

    def valid_value(self, c: Column) -> Column:
        parts = [self.test(c)]  # never null where c isn't
        for name, value in combined(self.checks).items():
            if name in _CHECKS:
                parts.append(_CHECKS[name](c, value, isinstance(self.spark(), T.ArrayType)))
            elif callable(value):
                parts.append(F.coalesce(value(c), F.lit(False)))
        return reduce(lambda a, b: a & b, parts)


def combined(checks: tuple[tuple[str, Any], ...]) -> dict[str, Any]:
    """Constraints by name: of lower bounds the largest holds, of upper ones the smallest, all patterns, and else the last."""
    out: dict[str, Any] = {}
    for name, value in checks:
        if name == "non_empty":
            name, value = "min_length", 1
        if name in ("min_value", "min_length") and name in out:
            value = max(out[name], value)
        elif name in ("max_value", "max_length") and name in out:
            value = min(out[name], value)
        elif name == "pattern":
            value = value.pattern if isinstance(value, re.Pattern) else value
            value = f"{out[name]}(?={value})" if name in out and out[name].startswith("(?=") else f"(?={out[name]})(?={value})" if name in out else value
        out[name] = value
    return out


def _length(c: Column, array: bool) -> Column:
    return F.size(c) if array else F.length(c)


_CHECKS: dict[str, Callable[[Column, Any, bool], Column]] = {
    "length": lambda c, v, a: _length(c, a) == v,
    "min_length": lambda c, v, a: _length(c, a) >= v,
    "max_length": lambda c, v, a: _length(c, a) <= v,
    "min_value": lambda c, v, a: c >= v,
    "max_value": lambda c, v, a: c <= v,
    "integer": lambda c, v, a: (c % 1 == 0) if v else F.lit(True),
    "pattern": lambda c, v, a: c.rlike(v),
}


@dataclass(frozen=True)
class Scalar(Node):
    name: str = "string"

    def spark(self) -> T.DataType:
        return {"string": T.StringType, "number": T.DoubleType, "integer": T.LongType, "bool": T.BooleanType, "date": T.TimestampType, "null": T.StringType, "any": T.StringType}[self.name]()

    def kind(self) -> dict[str, Any]:
        return {} if self.name == "any" else {"type": self.name}

    def test(self, c: Column) -> Column:
        return c.isNull() if self.name == "null" else F.lit(True)

    def required(self) -> bool:
        return self.name not in ("any", "null")


@dataclass(frozen=True)
class OneOf(Node):
    """Literals: a constant or an enumeration."""

    values: tuple = ()

    def spark(self) -> T.DataType:
        first = self.values[0]
        return T.BooleanType() if isinstance(first, bool) else T.DoubleType() if isinstance(first, (int, float)) else T.StringType()

    def kind(self) -> dict[str, Any]:
        return {"enum": list(self.values)}

    def test(self, c: Column) -> Column:
        return c.isin(list(self.values))


@dataclass(frozen=True)
class Wrapped(Node):
    """optional: may be absent; nullable: may be null; nullish: both."""

    inner: Node = field(default_factory=Scalar)
    mode: str = "optional"
    default: Any = None

    def spark(self) -> T.DataType:
        return self.inner.spark()

    def kind(self) -> dict[str, Any]:
        return self.inner.describe() if self.mode == "optional" else {"anyOf": [self.inner.describe(), {"type": "null"}]}

    def test(self, c: Column) -> Column:
        return self.inner.valid_value(c)

    def required(self) -> bool:
        return self.mode == "optional" and self.default is not None

    def children(self) -> Iterator[tuple[str, Node]]:
        return self.inner.children()


@dataclass(frozen=True)
class Array(Node):
    item: Node = field(default_factory=Scalar)

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark())

    def kind(self) -> dict[str, Any]:
        return {"type": "array", "items": self.item.describe()}

    def describe(self) -> dict[str, Any]:
        names = {"min_length": "min_items", "max_length": "max_items"}
        return {names.get(k, k): v for k, v in super().describe().items()}

    def test(self, c: Column) -> Column:
        free = isinstance(self.item, Wrapped)
        return F.forall(c, lambda x: F.coalesce(self.item.valid_value(x), F.lit(False)) | (x.isNull() if free else F.lit(False)))

    def children(self) -> Iterator[tuple[str, Node]]:
        yield "$[]", self.item


@dataclass(frozen=True)
class MapOf(Node):
    """An open map; with a key pattern, only keys that match it."""

    value: Node = field(default_factory=Scalar)
    key_pattern: str | None = None

    def spark(self) -> T.DataType:
        return T.MapType(T.StringType(), self.value.spark())

    def kind(self) -> dict[str, Any]:
        return {"type": "object", "patternProperties": {self.key_pattern: self.value.describe()}, "additionalProperties": False} if self.key_pattern else {"type": "object", "additionalProperties": self.value.describe()}

    def test(self, c: Column) -> Column:
        values = F.forall(F.map_values(c), lambda v: F.coalesce(self.value.valid_value(v), F.lit(False)))
        return values & F.forall(F.map_keys(c), lambda k: k.rlike(self.key_pattern)) if self.key_pattern else values

    def children(self) -> Iterator[tuple[str, Node]]:
        yield "$value", self.value


@dataclass(frozen=True)
class Object(Node):
    fields: Mapping[str, Node] = field(default_factory=dict)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(k, v.spark()) for k, v in self.fields.items()])

    def kind(self) -> dict[str, Any]:
        return {"type": "object", "required": [k for k, v in self.fields.items() if v.required() or isinstance(v, Wrapped) and v.mode == "nullable"], "properties": {k: v.describe() for k, v in self.fields.items()}}

    def test(self, c: Column) -> Column:
        return reduce(lambda a, b: a & b, [_field_valid(v, c.getField(k)) for k, v in self.fields.items()], F.lit(True))

    def children(self) -> Iterator[tuple[str, Node]]:
        yield from self.fields.items()

    def valid(self, schema: T.StructType) -> Column:
        """Whether a row of this Spark schema conforms; a field that the schema lacks is absent."""
        return reduce(lambda a, b: a & b, [_field_valid(v, quoted(k)) if k in schema.names else F.lit(not v.required()) for k, v in self.fields.items()], F.lit(True))

    def violations(self, schema: T.StructType) -> Column:
        """The names of the fields that don't conform."""
        return F.array_compact(F.array(*(F.when(~(_field_valid(v, quoted(k)) if k in schema.names else F.lit(not v.required())), k) for k, v in self.fields.items())))


@dataclass(frozen=True)
class Union(Node):
    """Any of several schemas. Objects share one struct of all their fields; `tag` names the field that tells them apart."""

    options: tuple[Node, ...] = ()
    tag: str | None = None

    def spark(self) -> T.DataType:
        kinds = [o.spark() for o in self.options]
        if all(isinstance(k, T.StructType) for k in kinds):
            merged: dict[str, T.StructField] = {}
            for kind in kinds:
                for f in kind.fields:
                    if f.name in merged and merged[f.name].dataType != f.dataType:
                        raise SchemaError(f"options of a union disagree on the type of {f.name}")
                    merged.setdefault(f.name, f)
            return T.StructType(list(merged.values()))
        return kinds[0] if all(k == kinds[0] for k in kinds) else T.VariantType()

    def kind(self) -> dict[str, Any]:
        return {"anyOf": [o.describe() for o in self.options]}

    def test(self, c: Column) -> Column:
        whole = self.spark()
        if isinstance(whole, T.VariantType):
            return reduce(lambda a, b: a | b, [F.try_variant_get(c, "$", o.spark().simpleString()).isNotNull() for o in self.options])
        return reduce(lambda a, b: a | b, [F.coalesce(o.valid_value(c), F.lit(False)) & self._alone(o, c) for o in self.options])

    def _alone(self, option: Node, c: Column) -> Column:
        if not isinstance(option, Object):
            return F.lit(True)
        others = [n for n in self.spark().names if n not in option.fields]
        return reduce(lambda a, b: a & b, [c.getField(n).isNull() for n in others], F.lit(True))

    def required(self) -> bool:
        return all(o.required() for o in self.options)

    def children(self) -> Iterator[tuple[str, Node]]:
        for i, o in enumerate(self.options):
            yield f"$union[{i}]", o


@dataclass(frozen=True)
class AllOf(Node):
    options: tuple[Object, ...] = ()

    def spark(self) -> T.DataType:
        return Object(fields={k: v for o in self.options for k, v in o.fields.items()}).spark()

    def kind(self) -> dict[str, Any]:
        return {"allOf": [o.describe() for o in self.options]}

    def test(self, c: Column) -> Column:
        return reduce(lambda a, b: a & b, [o.test(c) for o in self.options], F.lit(True))

    def children(self) -> Iterator[tuple[str, Node]]:
        for o in self.options:
            yield from o.fields.items()


def _field_valid(node: Node, c: Column) -> Column:
    if isinstance(node, Scalar) and node.name == "null":
        return c.isNull()
    good = node.valid_value(c)
    return c.isNotNull() & good if node.required() and not (isinstance(node, Wrapped)) else c.isNull() | good


def string(**checks: Any) -> Scalar:
    return Scalar(name="string").check(**checks)  # type: ignore[return-value]


def number(**checks: Any) -> Scalar:
    return Scalar(name="number").check(**checks)  # type: ignore[return-value]


def integer(**checks: Any) -> Scalar:
    return Scalar(name="integer").check(**checks)  # type: ignore[return-value]


def boolean() -> Scalar:
    return Scalar(name="bool")


def date(**checks: Any) -> Scalar:
    return Scalar(name="date").check(**checks)  # type: ignore[return-value]


def null() -> Scalar:
    return Scalar(name="null")


def anything() -> Scalar:
    return Scalar(name="any")


def literal(*values: Any) -> OneOf:
    return OneOf(values=values)


def optional(inner: Node, default: Any = None) -> Wrapped:
    return Wrapped(inner=inner, mode="optional", default=default)


def nullable(inner: Node) -> Wrapped:
    return Wrapped(inner=inner, mode="nullable")


def nullish(inner: Node) -> Wrapped:
    return Wrapped(inner=inner, mode="nullish")


def array(item: Node, **checks: Any) -> Array:
    return Array(item=item).check(**checks)  # type: ignore[return-value]


def record(value: Node, key_pattern: str | None = None) -> MapOf:
    return MapOf(value=value, key_pattern=key_pattern)


def obj(**fields: Node) -> Object:
    return Object(fields=fields)


def union(*options: Node, tag: str | None = None) -> Union:
    return Union(options=options, tag=tag)


def intersect(*options: Object) -> AllOf:
    return AllOf(options=options)


def ref_id(kind: str) -> Scalar:
    """An id of a document type: anything may follow its letters and digits."""
    return string(pattern=f"^{re.escape(kind)}:[a-zA-Z0-9]+")


def walk(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    """(path, node) of a schema, wrappers passed through."""
    yield path, node
    for name, child in node.children():
        yield from walk(child, f"{path}.{name}" if path else name)


@dataclass(frozen=True)
class Place:
    """Where a visitor is: the path from the root as a tuple, how deep, the node above, and the last part of the path."""

    path: tuple[str, ...] = ()
    depth: int = 0
    parent: Node | None = None
    key: str | None = None


def visit(node: Node, see: Callable[[Node | tuple[str, Any], Place], bool | None], place: Place | None = None) -> None:
    """Calls see(node, place) for every node of a schema, a parent before its children; False leaves its children out.

    Beside fields, `$[]` (items) and `$value`, paths have `$key` (the key pattern of an open map), `$union[i]` (an alternative) and
    `$pipe[i]` (a constraint of the node, seen as its name and value).
    """
    place = place or Place()
    if see(node, place) is False:
        return

    def below(key: str, child: Node | tuple[str, Any], through: bool = True) -> None:
        at = Place((*place.path, key), place.depth + 1, node, key)
        if isinstance(child, Node) and through:
            visit(child, see, at)
        else:
            see(child, at)

    for i, (name, value) in enumerate(node.checks):
        below(f"$pipe[{i}]", (name, value))
    if isinstance(node, Wrapped):
        for i, (name, value) in enumerate(node.inner.checks):
            below(f"$pipe[{len(node.checks) + i}]", (name, value))
    if isinstance(node, MapOf) and node.key_pattern is not None:
        below("$key", string(pattern=node.key_pattern), through=False)
    for name, child in node.children():
        below(name, child)


def indexes(node: Node) -> dict[str, Index]:
    """Dotted path -> index, the walker's own tokens left out."""
    out = {}
    for path, child in walk(node):
        found = child.index or (child.inner.index if isinstance(child, Wrapped) else None)
        if found:
            out[".".join(p for p in path.split(".") if not p.startswith("$"))] = found
    return out


def flat(schema: Mapping[str, Any] | Node, path: str = "") -> dict[str, str]:
    """Dotted path -> JSON text of the leaf there."""
    described = schema.describe() if isinstance(schema, Node) else schema
    if not isinstance(described, (dict, list)) or not described:
        return {path: json.dumps(described, sort_keys=True)}
    items = described.items() if isinstance(described, dict) else enumerate(described)
    out: dict[str, str] = {}
    for k, v in items:
        out |= flat(v, (f"{path}[{k}]" if isinstance(described, list) else f"{path}.{k}" if path else str(k)))
    return out


def difference(old: Node, new: Node) -> dict[str, list[str]]:
    """added, removed and changed paths."""
    a, b = flat(old), flat(new)
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def same(a: Any, b: Any) -> bool:
    """Equal whatever the order of keys; what can't be written as JSON is unequal."""
    try:
        return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    except (TypeError, ValueError):
        return False
