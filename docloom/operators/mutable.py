"""Collections and typed stores that can be written, over a versioned store."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.filters import compile_filter
from docloom.operators.collection import Collection, InvalidDocumentError, MultiCollection, NotFoundError
from docloom.operators.constraints import check_ids, check_unique, vacuum, wanted
from docloom.operators.updates import Told, bulk_updated, changed_columns, guard_delete, sanitize, split_set
from docloom.plans.stages import TYPE, unused
from docloom.schema import Node, Object, Wrapped
from docloom.sources.store import Store

_CROCKFORD = "0123456789abcdefghjkmnpqrstvwxyz"


def new_id() -> str:
    """A time-ordered id of 26 letters and digits: 48 bits of milliseconds, 80 of chance."""
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(_CROCKFORD[n >> s & 31] for s in range(125, -1, -5))


def prefixed_id(kind: str) -> str:
    return f"{kind}:{new_id()}"


def with_defaults(doc: Mapping[str, Any], schema: Object) -> dict[str, Any]:
    """Fields that the schema knows, absent ones filled with their defaults; others are left out."""
    out = {}
    for k, node in schema.fields.items():
        if k in doc:
            out[k] = doc[k]
        elif isinstance(node, Wrapped) and node.default is not None:
            out[k] = node.default() if callable(node.default) else node.default
    return out | ({"_id": doc["_id"]} if "_id" in doc else {})


def row_schema(schema: Object) -> T.StructType:
    kind = schema.spark()
    return kind if "_id" in kind.names else T.StructType([T.StructField("_id", T.StringType()), *kind.fields])


def _shape(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_shape(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_shape(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _shape(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.DoubleType) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


class BulkWriteError(RuntimeError):
    """errors by the place of their operation, and the results of the others."""

    def __init__(self, errors: dict[int, Exception], results: list[Any]):
        super().__init__("; ".join(f"operation {i}: {e}" for i, e in errors.items()))
        self.errors, self.results = errors, results


class _Writer:
    store: Store
    name: str

    def _frame(self, docs: Iterable[Mapping[str, Any]], kind: T.StructType) -> DataFrame:
        return self.store.spark.createDataFrame([_shape(d, kind) for d in docs], kind)

    def drop(self, force: bool = True) -> None:
        self.store.drop(self.name, force)

    def rename(self, to: str) -> None:
        self.store.rename(self.name, to)
        self.name = to


class MutableCollection(_Writer):
    """Documents of one schema. validate: rows are tested when written; what does not conform is refused."""

    def __init__(self, store: Store, name: str, schema: Object, safe_delete: bool = True):
        self.store, self.name, self.schema, self.safe_delete = store, name, schema, safe_delete
        store.create(name, row_schema(schema), exist_ok=True)
        if store.about(name).get("indexes") != (own := json.loads(json.dumps(wanted(schema), default=str))):
            store.about(name, indexes=own, validator=json.loads(json.dumps(schema.describe(), default=str)))

    @property
    def df(self) -> DataFrame:
        return self.store.read(self.name)

    @property
    def reader(self) -> Collection:
        return Collection(self.df, self.schema, trusted=True)

    def find(self, *args: Any, **options: Any) -> DataFrame:
        return self.reader.find(*args, **options)

    def find_one(self, spec: Any = None) -> Row | None:
        return self.reader.find_one(spec)

    def get_by_id(self, id: Any) -> Row:
        return self.reader.get_by_id(id)

    def count(self, spec: Any = None) -> int:
        return self.reader.count_documents(spec).first()[0]

    def paginate(self, *args: Any, **options: Any):
        return self.reader.paginate(*args, **options)

    def _validated(self, df: DataFrame) -> DataFrame:
        bad = df.where(~self.schema.valid(df.schema)).withColumn("_broken", self.schema.violations(df.schema)).limit(1).first()
        if bad is not None:
            raise InvalidDocumentError(f"{bad['_id']}: {', '.join(bad['_broken'])}")
        return df

    def insert_many(self, docs: Iterable[Mapping[str, Any]]) -> list[Any]:
        """The ids of the new documents; an id that a document brings must not be taken."""
        ready = [{"_id": new_id()} | with_defaults(sanitize(dict(d)), self.schema) for d in docs]
        self._insert(self._frame(ready, row_schema(self.schema)), [d["_id"] for d in ready])
        return [d["_id"] for d in ready]

    def insert_one(self, doc: Mapping[str, Any]) -> Any:
        return self.insert_many([doc])[0]

    def insert_frame(self, df: DataFrame) -> None:
        """Insert any number of rows. They are written first, and what was written is tested: df is evaluated once."""
        self._insert(df, None)

    def _insert(self, df: DataFrame, ids: list[Any] | None) -> None:
        def work() -> None:
            new = self.store.append(self.name, df)
            self._validated(new)
            check_ids(self.df, new, ids)
            check_unique(self.df, self.schema, new=new)
            self.store.record(self.name, "insert", new)

        self.store.retried(work)

    def _rewrite(self, operation: str, where: Any, change: Any, one: bool) -> int:
        """Change (to None: delete) the rows that match; with one, only the first by id. Files without such rows stay as they are."""

        def work() -> int:
            df = self.df
            match = compile_filter(where, df.schema)
            if one:
                first = df.where(match).orderBy("_id").limit(1).select("_id").first()
                if first is None:
                    return 0
                match = F.col("_id") == F.lit(first[0])
            hit = df.where(match)
            if change is None:
                n, changed = hit.count(), hit
            else:
                columns = {k: v.cast(df.schema[k].dataType) for k, v in change(df).items()}
                differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(k)) for k, v in columns.items()], F.lit(False))
                n = hit.where(differs).count()
                changed = hit.withColumns(columns)
            if n:
                if change is not None:
                    self._validated(changed)
                after = (lambda rows: rows.where(~F.coalesce(match, F.lit(False)))) if change is None else (lambda rows: rows.withColumns({k: F.when(match, v).otherwise(F.col(k)) for k, v in columns.items()}))
                self.store.rewrite(self.name, match, after)
                if change is not None:
                    check_unique(self.df, self.schema, new=changed)
                self.store.record(self.name, operation, changed)
            return n

        return self.store.retried(work)

    def update_many(self, where: Any, update: Mapping[str, Mapping[str, Any]], upsert: bool = False) -> int:
        return self._update(where, update, False, upsert)

    def update_one(self, where: Any, update: Mapping[str, Mapping[str, Any]], upsert: bool = False) -> int:
        return self._update(where, update, True, upsert)

    def _update(self, where: Any, update: Mapping[str, Mapping[str, Any]], one: bool, upsert: bool) -> int:
        def work() -> int:
            if upsert and self.count(where) == 0:
                equal = {k: v for k, v in where.items() if not k.startswith("$") and not isinstance(v, dict)}
                self.insert_one(equal | dict(update.get("$setOnInsert", {})) | dict(update.get("$set", {})))
                return 1
            return self._rewrite("update", where, lambda df: changed_columns(update, df.schema), one)

        return self.store.retried(work)

    def replace_one(self, where: Any, doc: Mapping[str, Any]) -> int:
        ready = with_defaults(sanitize(dict(doc)), self.schema)
        new = {"$set": {k: ready.get(k) for k in row_schema(self.schema).names if k != "_id"}}
        return self._rewrite("replace", where, lambda df: changed_columns(new, df.schema), True)

    def _first(self, where: Any) -> Row | None:
        return self.df.where(compile_filter(where, self.df.schema)).orderBy("_id").limit(1).first()

    def _found_one(self, where: Any, change: Any) -> Row | None:
        """The first document that matches, as it was, after change(its id)."""

        def work() -> Row | None:
            row = self._first(where)
            if row is not None:
                change({"_id": row["_id"]})
            return row

        return self.store.retried(work)

    def find_one_and_update(self, where: Any, update: Mapping[str, Mapping[str, Any]]) -> Row | None:
        """The document as it was."""
        return self._found_one(where, lambda id: self.update_one(id, update))

    def find_one_and_replace(self, where: Any, doc: Mapping[str, Any]) -> Row | None:
        return self._found_one(where, lambda id: self.replace_one(id, doc))

    def find_one_and_delete(self, where: Any) -> Row | None:
        return self._found_one(where, self.delete_one)

    def delete_one(self, where: Any) -> int:
        if self.safe_delete:
            guard_delete(where)
        return self._rewrite("delete", where, None, True)

    def delete_many(self, where: Any) -> int:
        if self.safe_delete:
            guard_delete(where)
        return self._rewrite("delete", where, None, False)

    def bulk_write(self, operations: list[Mapping[str, Any]], ordered: bool = True) -> list[Any]:
        """Operations such as {"insert_one": {...}} or {"update_one": (filter, update)}, in order, and what each returns.

        Ordered: one commit of all, or none where one fails. Unordered: each is a commit of its own; those that fail
        are tried no more, the others stand, and the errors are raised together at the end.
        """

        def one(operation: Mapping[str, Any]) -> Any:
            (name, given), = operation.items()
            return getattr(self, name)(*given) if isinstance(given, (tuple, list)) and name != "insert_many" else getattr(self, name)(given)

        if ordered:
            return self.store.retried(lambda: [one(o) for o in operations])
        out, errors = [], {}
        for i, operation in enumerate(operations):
            try:
                out.append(one(operation))
            except Exception as e:  # whatever an operation raises is told with its place
                out.append(None)
                errors[i] = e
        if errors:
            raise BulkWriteError(errors, out)
        return out

    def merge_frame(self, changes: DataFrame, insert: bool = True, order: str | None = None, with_nulls: bool = False) -> None:
        """Upsert any number of rows by id, with one join. Several changes for one id are folded to that of the largest `order`, or refused without it."""

        def work() -> None:
            before = self.df
            ids = changes.select("_id").distinct()
            after = bulk_updated(before, changes, insert=insert, order=order, with_nulls=with_nulls)
            self.store.write(self.name, after)
            changed = self.df.join(ids, "_id", "left_semi")
            self._validated(changed)
            check_unique(self.df, self.schema, new=changed)
            self.store.record(self.name, "update", changed)

        self.store.retried(work)

    def vacuum(self, now: Column | None = None) -> None:
        """Take expired documents out."""
        self.store.write(self.name, vacuum(self.df, self.schema, now))


class MutableMulti(_Writer):
    """Documents of several types; only the folders of types that a write touches are written anew."""

    def __init__(self, store: Store, name: str, types: Mapping[str, Object], create: bool = True, safe_delete: bool = True):
        self.store, self.name, self.types, self.safe_delete = store, name, dict(types), safe_delete
        self.row_schema = self.rows_of(types)
        if create:
            store.create(name, self.row_schema, typed=True, exist_ok=True)

    @staticmethod
    def rows_of(types: Mapping[str, Object]) -> T.StructType:
        """The fields of all types together, with the id and the type."""
        fields: dict[str, T.StructField] = {"_id": T.StructField("_id", T.StringType()), TYPE: T.StructField(TYPE, T.StringType())}
        for node in types.values():
            for f in node.spark().fields:
                fields.setdefault(f.name, f)
        return T.StructType(list(fields.values()))

    @property
    def df(self) -> DataFrame:
        return self.store.read(self.name)

    @property
    def reader(self) -> MultiCollection:
        return MultiCollection(self.df, self.types, trusted=True)

    def _schema(self, key: str) -> Object:
        if key not in self.types:
            raise KeyError(f"unknown document type {key}")
        return self.types[key]

    def insert_many(self, key: str, docs: Iterable[Mapping[str, Any]]) -> list[str]:
        schema = self._schema(key)
        ready = [{"_id": prefixed_id(key)} | with_defaults(sanitize(dict(d)), schema) for d in docs]
        names = [f for f in self.row_schema.fields if f.name != TYPE]
        df = self._frame(ready, T.StructType(names))

        def work() -> None:
            new = self.store.append(self.name, df, key)
            bad = new.where(~schema.valid(new.schema)).withColumn("_broken", schema.violations(new.schema)).limit(1).first()
            if bad is not None:
                raise InvalidDocumentError(f"{bad['_id']}: {', '.join(bad['_broken'])}")
            check_ids(self.df, new, [d["_id"] for d in ready])
            check_unique(self.store.read(self.name, [key]), schema, key, new)
            self.store.record(self.name, "insert", new)

        self.store.retried(work)
        return [d["_id"] for d in ready]

    def insert_one(self, key: str, doc: Mapping[str, Any]) -> str:
        return self.insert_many(key, [doc])[0]

    def _check_id(self, key: str, id: str) -> None:
        if not str(id).startswith(f"{key}:") and not isinstance(self.types[key].fields.get("_id"), Node):
            raise ValueError(f"invalid id {id} for type {key}")

    def update_one(self, key: str, id: str, fields: Mapping[str, Any]) -> int:
        """Set (or REMOVE) paths of one document; how many documents changed."""
        self._schema(key)
        return self._set(key, {id: fields}) if split_set(fields) else 0

    def update_many(self, changes: Mapping[str, Mapping[str, Mapping[str, Any]]]) -> int:
        """{type: {id: {path: value}}} as one commit; how many documents changed. Ids that a type doesn't have are passed over."""
        if not any(changes.values()):
            raise ValueError("no element to update")
        for key, by_id in changes.items():
            self._schema(key)
            for id in by_id:
                self._check_id(key, id)
        return self.store.retried(lambda: sum(self._set(key, by_id, must=False) for key, by_id in changes.items()))

    def _set(self, key: str, by_id: Mapping[str, Mapping[str, Any]], must: bool = True) -> int:
        """Each id's paths set. Ids with the same paths are one join with their values: plans grow with the sets of paths and not with the ids."""

        def work() -> int:
            df, total = self.store.read(self.name, [key]), 0
            if must and df.where(F.col("_id").isin(list(by_id))).isEmpty():
                raise NotFoundError(f"no element found: {', '.join(by_id)}")
            alike: dict[tuple, list[tuple[str, dict]]] = {}
            for id, fields in by_id.items():
                if update := split_set(fields):
                    alike.setdefault(tuple((op, *sorted(update[op])) for op in sorted(update)), []).append((id, update))
            for group in alike.values():
                total += self._change(key, group)
            return total

        return self.store.retried(work)

    def _change(self, key: str, group: list[tuple[str, dict]]) -> int:
        """Updates of the same paths: (id, update)."""
        df, schema = self.store.read(self.name, [key]), self._schema(key)
        first = group[0][1]
        paths = list(first.get("$set", {}))
        told = [(i, *(json.dumps({"v": u["$set"][p]}, default=str) for p in paths)) for i, u in group]
        names = unused(df, "_changed", *(f"_v{n}" for n in range(len(paths))))
        values = F.broadcast(self.store.spark.createDataFrame(told, T.StructType([T.StructField(n, T.StringType()) for n in names])))  # what the caller has in hand
        update = {op: dict(fields) for op, fields in first.items()} | ({"$set": {p: Told(F.col(n)) for p, n in zip(paths, names[1:], strict=True)}} if paths else {})
        hit = F.col(names[0]).isNotNull()
        columns = {k: v.cast(df.schema[k].dataType) for k, v in changed_columns(update, df.schema).items()}

        def joined(rows: DataFrame, how: str) -> DataFrame:
            return rows.join(values, F.col("_id") == F.col(names[0]), how)

        differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(k)) for k, v in columns.items()])
        n = joined(df, "inner").where(differs).count()
        changed = joined(df, "inner").withColumns(columns).drop(*names)
        if n:
            if not changed.where(~schema.valid(df.schema)).isEmpty():
                raise InvalidDocumentError(f"an update of {key} leaves documents that do not conform")
            match = F.col("_id").isin([i for i, _ in group])
            self.store.rewrite(self.name, match, lambda rows: joined(rows, "left").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in columns.items()}).drop(*names), [key])
            check_unique(self.store.read(self.name, [key]), schema, key, changed)
            self.store.record(self.name, "update", changed)
        return n

    def delete_ids(self, key: str, ids: list[str]) -> int:
        for id in ids:
            self._check_id(key, id)
        return self._delete([key], F.col("_id").isin(ids), must=True)

    def delete_id(self, key: str, id: str) -> int:
        return self.delete_ids(key, [id])

    def delete_many(self, key: str, where: Any) -> int:
        self._schema(key)
        if self.safe_delete:
            guard_delete(where)
        return self._delete([key], where)

    def delete_any(self, where: Any) -> int:
        if self.safe_delete:
            guard_delete(where)
        return self._delete(list(self.types), where)

    def _delete(self, keys: list[str], where: Any, must: bool = False) -> int:
        def work() -> int:
            n = 0
            for key in keys:
                df = self.store.read(self.name, [key])
                match = compile_filter(where, df.schema)
                gone = df.where(match)
                own = gone.count()
                if own:
                    self.store.rewrite(self.name, match, lambda rows, match=match: rows.where(~F.coalesce(match, F.lit(False))), [key])
                    self.store.record(self.name, "delete", gone)
                n += own
            if must and n == 0:
                raise NotFoundError("no element found to delete")
            return n

        return self.store.retried(work)


def new_multi(store: Store, name: str, types: Mapping[str, Object], safe_delete: bool = True) -> MutableMulti:
    """A typed store that must not exist yet, not tracked by migrations; refused within a unit of work, as tables aren't made in one."""
    if store.in_unit:
        raise RuntimeError(f"{name} can't be made within a unit of work")
    store.create(name, MutableMulti.rows_of(types), typed=True)
    apply_constraints(store, name, types)
    return MutableMulti(store, name, types, create=False, safe_delete=safe_delete)


def new_instance(store: Store, name: str, model: str, types: Mapping[str, Object], at: str = "current") -> MutableMulti:
    """The same, tracked as an instance of a model: migrations of the model that are made after `at` (the id of the last one it has) concern it."""
    out = new_multi(store, name, types)
    store.about(name, model=model, created=at)
    return out


def apply_constraints(store: Store, name: str, schema: Object | Mapping[str, Object]) -> None:
    """Test a table's rows and keys against a schema (or schemas by type) and note validators and indexes with it; a missing table is an error."""
    if name not in store.tables():
        raise KeyError(f"no table {name}")
    types = {None: schema} if isinstance(schema, Object) else dict(schema)
    for key, own in types.items():
        df = store.read(name, [key] if key else None)
        bad = df.where(~own.valid(df.schema)).limit(1).first()
        if bad is not None:
            raise InvalidDocumentError(f"{name}: {bad['_id']} does not conform")
        check_unique(df, own, key)
    described = schema.describe() if isinstance(schema, Object) else {k: v.describe() for k, v in schema.items()}
    store.about(name, indexes=json.loads(json.dumps(wanted(schema), default=str)), validator=json.loads(json.dumps(described, default=str)))
