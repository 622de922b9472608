"""Index declarations as constraints: uniqueness, time to live, and the plan that brings stored ones up to date."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.filters import compile_filter
from docloom.functions.paths import value_at
from docloom.plans.stages import TYPE
from docloom.schema import Index, Node, indexes


#: Ids that are looked up by a filter of the scan; more are joined.
FEW_IDS = 1000


class DuplicateKeyError(ValueError):
    pass


def folded(index: Index, column: Column) -> Column:
    """A key as it is compared: in lower case where case doesn't count (accents do)."""
    strength = (index.collation or {}).get("strength", 3)
    return F.lower(column.cast("string")) if index.insensitive or strength <= 2 else column


def _concerned(df: DataFrame, index: Index, type_name: str | None) -> DataFrame:
    df = df.where(F.col(TYPE) == type_name) if type_name else df
    return df.where(compile_filter(index.where, df.schema)) if index.where else df


def violations(df: DataFrame, path: str, index: Index, type_name: str | None = None, touched: DataFrame | None = None) -> DataFrame:
    """key, n: keys that more than one row has. touched(key) limits the test to keys that a commit brings; nulls are not keys."""
    rows = _concerned(df, index, type_name).select(folded(index, value_at(df.schema, path)).alias("key")).where("key is not null")
    if touched is not None:
        rows = rows.join(touched.select(folded(index, F.col("key")).alias("key")).distinct(), "key", "left_semi")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_ids(df: DataFrame, new: DataFrame, given: list[Any] | None = None) -> None:
    """Raises where rows of `new` bring an `_id` that another row of df has; `given` are their ids where they are known, few enough to be a filter of the scan."""
    ids = df.select("_id").where(F.col("_id").isin(given)) if given is not None and len(given) <= FEW_IDS else df.select("_id").join(new.select("_id").distinct(), "_id", "left_semi")
    bad = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).first()
    if bad is not None:
        raise DuplicateKeyError(f"duplicate key _id: {bad['_id']}")


def check_unique(df: DataFrame, schema: Node, type_name: str | None = None, new: DataFrame | None = None) -> None:
    """Raises on a duplicate key of an index; with `new`, only keys of these rows are looked at."""
    for path, index in indexes(schema).items():
        if index.unique:
            touched = new.select(value_at(new.schema, path).alias("key")) if new is not None else None
            bad = violations(df, path, index, type_name, touched).limit(1).first()
            if bad is not None:
                raise DuplicateKeyError(f"duplicate key {path}: {bad.key}")


def expired(df: DataFrame, path: str, index: Index, now: Column | None = None, type_name: str | None = None) -> Column:
    """Rows past their time to live; only those that the index's filter concerns."""
    at = value_at(df.schema, path).cast("timestamp")
    late = at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(index.expire_after or 0))) <= (now if now is not None else F.current_timestamp())
    own = compile_filter(index.where, df.schema) if index.where else F.lit(True)
    own = own & (F.col(TYPE) == type_name) if type_name else own
    return F.coalesce(own & late, F.lit(False))


def vacuum(df: DataFrame, schema: Node, now: Column | None = None, type_name: str | None = None) -> DataFrame:
    """df without the rows that have expired."""
    for path, index in indexes(schema).items():
        if index.expire_after is not None:
            df = df.where(~expired(df, path, index, now, type_name))
    return df


def normal(index: Index) -> dict[str, Any]:
    """An index's options in one spelling: of a collation locale and strength, and `insensitive` as that collation."""
    options = {k: v for k, v in asdict(index).items() if v not in (None, False)}
    collation = {"locale": "en", "strength": 2} if options.pop("insensitive", False) else options.pop("collation", None)
    if collation:
        options["collation"] = {k: collation[k] for k in ("locale", "strength") if k in collation}
    return options


def wanted(schemas: Mapping[str, Node] | Node) -> dict[str, dict[str, Any]]:
    """Index name -> key and options: of a schema, or of the types of a store (each limited to its type, beside one on the type itself)."""
    if isinstance(schemas, Node):
        return {f"{path}_1": {"key": path, **normal(i)} for path, i in indexes(schemas).items()}
    out: dict[str, dict[str, Any]] = {f"{TYPE}_1": {"key": TYPE}}
    for name, schema in schemas.items():
        for path, i in indexes(schema).items():
            own = {TYPE: {"$eq": name}}
            options = normal(i) | {"where": {"$and": [own, i.where]} if i.where else own}
            out[f"{name}_{path}"] = {"key": path, **options}
    return out


def index_plan(existing: Mapping[str, Mapping[str, Any]], target: Mapping[str, Mapping[str, Any]]) -> dict[str, list[str]]:
    """create, recreate (options differ), drop and keep: index names."""
    return {
        "create": sorted(target.keys() - existing.keys()),
        "recreate": sorted(k for k in target.keys() & existing.keys() if dict(target[k]) != dict(existing[k])),
        "drop": sorted(existing.keys() - target.keys()),
        "keep": sorted(k for k in target.keys() & existing.keys() if dict(target[k]) == dict(existing[k])),
    }
