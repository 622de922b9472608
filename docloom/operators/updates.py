"""Updates and deletes as DataFrame transforms, and the clean-up of documents before they are written."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.filters import compile_filter
from docloom.functions.paths import quoted, value_at


class _Sentinel:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


#: A value that isn't given.
MISSING = _Sentinel("MISSING")
#: As a value of $set: take the field away.
REMOVE = _Sentinel("REMOVE")


class partial(dict):
    """As a value of $set: merge into the object there; a plain dict replaces it."""


class UndefinedValueError(ValueError):
    pass


def sanitize(value: Any, mode: str = "remove", path: str = "") -> Any:
    """A document without MISSING values: "remove" and "ignore" leave them out, "error" refuses them; lists lose them too, other objects stay."""
    if mode not in ("remove", "ignore", "error"):
        raise ValueError(f"unknown mode {mode}")
    if isinstance(value, dict):
        items = {}
        for k, v in value.items():
            if v is MISSING:
                if mode == "error":
                    raise UndefinedValueError(f"undefined value at {path}.{k}".replace(" .", " "))
                continue
            items[k] = sanitize(v, mode, f"{path}.{k}" if path else k)
        return type(value)(items)
    if isinstance(value, list):
        if mode == "error" and any(v is MISSING for v in value):
            raise UndefinedValueError(f"undefined value in {path or 'a list'}")
        return [sanitize(v, mode, path) for v in value if v is not MISSING]
    return value


def remove_undefined(doc: Mapping[str, Any], deep: bool = True) -> dict[str, Any]:
    return sanitize(dict(doc)) if deep else {k: v for k, v in doc.items() if v is not MISSING}


def undefined_to_null(value: Any, deep: bool = True) -> Any:
    if value is MISSING:
        return None
    if isinstance(value, dict):
        return {k: undefined_to_null(v) if deep else (None if v is MISSING else v) for k, v in value.items()}
    if isinstance(value, list) and deep:
        return [undefined_to_null(v) for v in value]
    return value


def split_set(fields: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """$set and $unset of fields: REMOVE goes to $unset, partial objects become dotted paths."""
    sets: dict[str, Any] = {}
    unsets: dict[str, Any] = {}

    def put(path: str, value: Any) -> None:
        if value is REMOVE:
            unsets[path] = ""
        elif isinstance(value, partial):
            for k, v in value.items():
                put(f"{path}.{k}", v)
        elif value is not MISSING:
            sets[path] = sanitize(value)

    for k, v in fields.items():
        put(k, v)
    return {k: v for k, v in (("$set", sets), ("$unset", unsets)) if v}


class Told:
    """A value that a column tells as JSON: {"v": value}."""

    def __init__(self, column: Column):
        self.column = column


def literal_of(value: Any, kind: T.DataType) -> Column:
    """A Python value as a Column of a type; fields that a struct lacks are null."""
    if isinstance(value, Told):
        return F.from_json(value.column, T.StructType([T.StructField("v", kind)])).getField("v")
    if isinstance(value, Column):
        return value.cast(kind)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        unknown = set(value) - set(kind.names)
        if unknown:
            raise KeyError(f"unknown fields {sorted(unknown)}")
        return F.struct(*(literal_of(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return F.array(*(literal_of(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return F.create_map(*(c for k, v in value.items() for c in (F.lit(k), literal_of(v, kind.valueType)))).cast(kind) if value else F.create_map().cast(kind)
    return F.lit(value).cast(kind)


Change = Callable[[Column, T.DataType], Column]


def change_at(column: Column, kind: T.DataType, parts: list[str], change: Change) -> Column:
    """column with the value at a path changed. A number is a place in an array (one after its end appends), $[] all of them. Unknown paths are refused."""
    if not parts:
        return change(column, kind)
    head, rest = parts[0], parts[1:]
    if isinstance(kind, T.StructType):
        if head not in kind.names:
            raise KeyError(f"unknown path {head}")
        whole = F.coalesce(column, F.from_json(F.lit("{}"), kind))
        return whole.withField(head, change_at(whole.getField(head), kind[head].dataType, rest, change))
    if isinstance(kind, T.ArrayType) and head == "$[]":
        return F.transform(column, lambda x: change_at(x, kind.elementType, rest, change))
    if isinstance(kind, T.ArrayType) and head.isdigit():
        at = int(head)
        items = F.coalesce(column, F.array().cast(kind))
        changed = F.transform(items, lambda x, i: F.when(i == at, change_at(x, kind.elementType, rest, change)).otherwise(x))
        new = change_at(F.lit(None).cast(kind.elementType), kind.elementType, rest, change)
        return F.when(F.size(items) > at, changed).otherwise(F.concat(items, F.array_repeat(F.lit(None).cast(kind.elementType), F.lit(at) - F.size(items)), F.array(new)))
    if isinstance(kind, T.MapType):
        whole = F.coalesce(column, F.create_map().cast(kind))
        value = change_at(F.try_element_at(whole, F.lit(head)), kind.valueType, rest, change)
        return F.map_concat(F.map_filter(whole, lambda k, v: k != head), F.create_map(F.lit(head), value))
    raise KeyError(f"unknown path {head}")


def _number(f: Callable[[Column, Column], Column], start: int) -> Callable[[Any], Change]:
    return lambda v: lambda c, k: f(F.coalesce(c, F.lit(start).cast(k)), F.lit(v)).cast(k)


def _each(value: Any) -> list:
    return value["$each"] if isinstance(value, dict) and "$each" in value else [value]


def _items(c: Column, k: T.DataType) -> Column:
    return F.coalesce(c, F.array().cast(k))


def _push(value: Any) -> Change:
    return lambda c, k: F.concat(_items(c, k), literal_of(_each(value), k))


def _add_to_set(value: Any) -> Change:
    return lambda c, k: F.concat(_items(c, k), F.array_except(literal_of(_each(value), k), _items(c, k)))


def _pull(value: Any) -> Change:
    return lambda c, k: F.filter(c, lambda x: ~x.eqNullSafe(literal_of(value, k.elementType)))


_CHANGES: dict[str, Callable[[Any], Change]] = {
    "$set": lambda v: lambda c, k: literal_of(v, k),
    "$unset": lambda v: lambda c, k: F.lit(None).cast(k),
    "$inc": _number(lambda a, b: a + b, 0),
    "$mul": _number(lambda a, b: a * b, 0),
    "$min": lambda v: lambda c, k: F.least(c, literal_of(v, k)),
    "$max": lambda v: lambda c, k: F.greatest(c, literal_of(v, k)),
    "$push": _push,
    "$addToSet": _add_to_set,
    "$pull": _pull,
}


def changed_columns(update: Mapping[str, Mapping[str, Any]], schema: T.StructType) -> dict[str, Column]:
    """The columns that an update document changes, and their new values."""
    parts: dict[str, Any] = {}
    for op, fields in update.items():
        if op == "$setOnInsert":
            continue
        if op not in _CHANGES:
            raise ValueError(f"unknown update operator {op}")
        split = split_set(fields) if op == "$set" else {op: fields}
        for own, items in split.items():
            parts.setdefault(own, {}).update(items)
    out: dict[str, Column] = {}
    for op, fields in parts.items():
        for path, value in fields.items():
            head, *rest = path.split(".")
            if head not in schema.names:
                raise KeyError(f"unknown path {path}")
            out[head] = change_at(out.get(head, quoted(head)), schema[head].dataType, rest, _CHANGES[op](value))
    return out


def updated(df: DataFrame, where: Any, update: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """df with the update applied to the rows that match."""
    match = compile_filter(where, df.schema)
    return df.withColumns({k: F.when(match, v).otherwise(quoted(k)) for k, v in changed_columns(update, df.schema).items()})


def deleted(df: DataFrame, where: Any) -> DataFrame:
    return df.where(~compile_filter(where, df.schema))


def deleted_ids(df: DataFrame, ids: DataFrame, id_col: str = "_id") -> DataFrame:
    """df without the rows whose id is in ids: an anti join, for any number of ids."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)


def guard_delete(where: Any) -> None:
    """Refuses a filter that would delete all, or names only an id that isn't given."""
    if isinstance(where, Column):
        return
    given = {k: v for k, v in (where or {}).items() if v is not MISSING and v is not None}
    if not given:
        raise ValueError("a delete without a filter is refused; pass safe=False to delete all documents")


def folded_changes(changes: DataFrame, id_col: str = "_id", order: str | None = None) -> DataFrame:
    """One row for each id: that of the largest `order`, without this column; without order, a second row for an id fails the query."""
    columns = [c for c in changes.columns if c not in (id_col, order)]
    row = F.struct(*(quoted(c) for c in columns), F.lit(1).alias("_one"))
    if order is not None:
        folded = changes.groupBy(quoted(id_col).alias(id_col)).agg(F.max_by(row, quoted(order)).alias("_row"))
    else:
        n = F.count(F.lit(1))
        twice = F.raise_error(F.concat(F.lit("two changes for id "), quoted(id_col).cast("string")))
        folded = changes.groupBy(quoted(id_col).alias(id_col)).agg(F.first(row).alias("_row"), n.alias("_n"))
        folded = folded.withColumn("_row", F.when(F.col("_n") > 1, twice.cast(folded.schema["_row"].dataType)).otherwise(F.col("_row")))
    return folded.select(quoted(id_col), *(F.col("_row").getField(c).alias(c) for c in columns))


def bulk_updated(df: DataFrame, changes: DataFrame, id_col: str = "_id", insert: bool = False, order: str | None = None, with_nulls: bool = False) -> DataFrame:
    """df with rows replaced column by column from changes(id, columns...). A null there leaves the old value, or with_nulls is the new one. With insert, ids that df lacks are added.

    Several changes for one id are folded to that of the largest `order`, a column of changes; without order they fail the query.
    """
    columns = [c for c in changes.columns if c not in (id_col, order)]
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise KeyError(f"unknown columns {sorted(unknown)}")
    named = folded_changes(changes, id_col, order).select(F.col(id_col).alias("_change_id"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(named, F.col(id_col) == F.col("_change_id"), "full" if insert else "left")
    new = lambda c: F.when(F.col("_change_id").isNotNull(), F.col(f"_new_{c}")).otherwise(quoted(c)) if with_nulls else F.coalesce(F.col(f"_new_{c}"), quoted(c))
    pick = {c: new(c).cast(df.schema[c].dataType) for c in columns}
    return joined.select(*(F.coalesce(quoted(c), F.col("_change_id")).alias(c) if c == id_col else pick.get(c, quoted(c)).alias(c) for c in df.columns))


def modified_count(df: DataFrame, where: Any, update: Mapping[str, Mapping[str, Any]]) -> Column:
    """An aggregate: how many matching rows an update really changes."""
    match = compile_filter(where, df.schema)
    differs = [~v.eqNullSafe(value_at(df.schema, k)) for k, v in changed_columns(update, df.schema).items()]
    return F.count(F.when(match & reduce(lambda a, b: a | b, differs, F.lit(False)), 1))
