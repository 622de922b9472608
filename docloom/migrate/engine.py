"""Building migrations, and applying and reversing them: on DataFrames, and on a store in one commit."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.migrate.model import FrameChange, Migration, MigrationError, Operation, RowChange, Schemas, State, is_after, is_ancestor
from docloom.operators.mutable import _shape, apply_constraints, prefixed_id, row_schema, with_defaults
from docloom.plans.stages import TYPE
from docloom.schema import Array, MapOf, Node, Object, OneOf, Scalar, Union, Wrapped
from docloom.sources.store import Store

# --- building


def by_rows(change: RowChange, schema: T.StructType) -> FrameChange:
    """A change of single documents (dicts) as one of DataFrames, for what Columns can't express."""

    def run(df: DataFrame) -> DataFrame:
        def each(batches):
            import pandas as pd

            for pdf in batches:
                rows = [change(r) for r in pdf.to_dict("records")]
                yield pd.DataFrame([[r.get(n) for n in schema.names] for r in rows], columns=schema.names)

        return df.mapInPandas(each, schema)

    return run


class _Target:
    def __init__(self, builder: Builder, kinds: tuple[str, str], target: str, type_name: str | None = None):
        self.builder, self.kinds, self.target, self.type_name = builder, kinds, target, type_name

    def type(self, name: str) -> _Target:
        return _Target(self.builder, self.kinds, self.target, name)

    def seed(self, docs: Iterable[Mapping[str, Any]]) -> _Target:
        self.builder.add(Operation(self.kinds[0], self.target, self.type_name, docs=tuple(docs)))
        return self

    def transform(self, up: FrameChange, down: FrameChange | None = None, *, irreversible: bool = False, lossy: bool = False) -> _Target:
        self.builder.add(Operation(self.kinds[1], self.target, self.type_name, up=up, down=down, irreversible=irreversible or down is None, lossy=lossy))
        return self

    def delete_type(self, name: str) -> _Target:
        kind = "delete_models_type" if self.kinds[0] == "seed_models_type" else "delete_multi_type"
        self.builder.add(Operation(kind, self.target, name, irreversible=True))
        return self

    def rename_type(self, old: str, new: str) -> _Target:
        kind = "rename_models_type" if self.kinds[0] == "seed_models_type" else "rename_multi_type"
        self.builder.add(Operation(kind, self.target, old, new_type=new))
        return self


class Builder:
    """Collects operations; parent holds the schemas before the migration."""

    def __init__(self, schemas: Schemas, parent: Schemas | None = None):
        self.schemas, self.parent, self.operations = schemas, parent or Schemas(), []

    def add(self, operation: Operation) -> Builder:
        self.operations.append(operation)
        return self

    def create_collection(self, name: str) -> _Target:
        self.add(Operation("create_collection", name, lossy=True))
        return self.collection(name)

    def create_multi(self, name: str) -> _Target:
        self.add(Operation("create_multi", name, lossy=True))
        return self.multi(name)

    def create_instance(self, name: str, model: str) -> _Target:
        self.add(Operation("create_instance", name, model=model, lossy=True))
        return self.instance(name)

    def mark_instance(self, name: str, model: str) -> Builder:
        return self.add(Operation("mark_instance", name, model=model))

    def update_indexes(self, name: str) -> Builder:
        return self.add(Operation("update_indexes", name, lossy=True))

    def collection(self, name: str) -> _Target:
        return _Target(self, ("seed_collection", "transform_collection"), name)

    def multi(self, name: str) -> _Target:
        return _Target(self, ("seed_multi_type", "transform_multi_type"), name)

    def instance(self, name: str) -> _Target:
        return _Target(self, ("seed_instance_type", "transform_instance_type"), name)

    def instances(self, model: str) -> _Target:
        return _Target(self, ("seed_models_type", "transform_models_type"), model)

    def summary(self) -> dict[str, Any]:
        counts: dict[str, int] = {}
        for o in self.operations:
            counts[o.kind] = counts.get(o.kind, 0) + 1
        return {"operations": len(self.operations), "by_kind": counts, "irreversible": any(o.irreversible for o in self.operations), "lossy": any(o.lossy for o in self.operations)}


def operations_of(m: Migration) -> Builder:
    builder = Builder(m.schemas, m.parent.schemas if m.parent else None)
    m.migrate(builder)
    return builder


# --- rows


def _empty(spark: SparkSession, types: Mapping[str, Object] | None, schema: Object | None = None) -> DataFrame:
    if schema is not None:
        return spark.createDataFrame([], row_schema(schema))
    fields: dict[str, T.StructField] = {"_id": T.StructField("_id", T.StringType()), TYPE: T.StructField(TYPE, T.StringType())}
    for node in (types or {}).values():
        for f in node.spark().fields:
            fields.setdefault(f.name, f)
    return spark.createDataFrame([], T.StructType(list(fields.values())))


def _rows(spark: SparkSession, docs: Iterable[Mapping[str, Any]], schema: Object, type_name: str | None) -> DataFrame:
    kind = row_schema(schema)
    made = [{"_id": prefixed_id(type_name or "doc")} | with_defaults(d, schema) for d in docs]
    df = spark.createDataFrame([_shape(d, kind) for d in made], kind)
    if not df.where(~schema.valid(df.schema)).isEmpty():
        raise MigrationError("seeded documents do not conform to the schema")
    return df.withColumn(TYPE, F.lit(type_name)) if type_name else df


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    return b if not a.columns else a.unionByName(b, allowMissingColumns=True)


def _on_type(df: DataFrame, type_name: str, change: FrameChange) -> DataFrame:
    """One type's rows changed; they show the change only columns in which they have values."""
    own = df.where(F.col(TYPE) == type_name)
    return df.where(F.col(TYPE) != type_name).unionByName(change(own.drop(TYPE)).withColumn(TYPE, F.lit(type_name)), allowMissingColumns=True)


def _renamed(df: DataFrame, old: str, new: str, ids: bool) -> DataFrame:
    own = F.col(TYPE) == old
    df = df.withColumn("_id", F.when(own & F.col("_id").startswith(f"{old}:"), F.concat(F.lit(new), F.substr("_id", F.lit(len(old) + 1)))).otherwise(F.col("_id"))) if ids else df
    return df.withColumn(TYPE, F.when(own, new).otherwise(F.col(TYPE)))


# --- operations: (spark, state, operation, schemas, id of the migration) -> state


def _instances(state: State, model: str, at: str, only: str | None = None) -> list[str]:
    """Instances of a model that a migration concerns: not those made after it."""
    return [n for n, m in state.model_of.items() if m == model and (only is None or n == only) and not is_after(state.created_at.get(n, "unknown"), at)]


def concerns(m: Migration, made_by: str, migrations: Iterable[Migration] = ()) -> bool:
    """Whether a migration concerns an instance that another one has made: by ancestry where both are known (it has to come after the
    maker on its own line, or be on no line with it and not be older), and else by time."""
    if made_by in ("unknown", "current", m.id):
        return made_by == "unknown"
    maker = next((x for x in migrations if x.id == made_by), None)
    if maker is not None:
        if is_ancestor(maker, m):
            return True
        if is_ancestor(m, maker):
            return False
    return not is_after(made_by, m.id)


def _create_collection(spark, state, op, schemas, at):
    return state if op.target in state.collections else state.put("collections", op.target, _empty(spark, None, schemas.collections[op.target]))


def _create_multi(spark, state, op, schemas, at):
    return state if op.target in state.multi else state.put("multi", op.target, _empty(spark, schemas.multi[op.target]))


def _create_instance(spark, state, op, schemas, at):
    if op.target in state.instances:
        return state
    state = state.put("instances", op.target, _empty(spark, schemas.models[op.model]))
    return state.put("model_of", op.target, op.model).put("created_at", op.target, at)


def _drop_instance(spark, state, op, schemas, at):
    return state.drop("instances", op.target).drop("model_of", op.target).drop("created_at", op.target)


def _mark_instance(spark, state, op, schemas, at):
    if op.target in state.model_of:
        raise MigrationError(f"{op.target} is an instance of {state.model_of[op.target]} already")
    rows = state.multi.get(op.target)
    if rows is None:
        raise MigrationError(f"no store {op.target}")
    return state.drop("multi", op.target).put("instances", op.target, rows).put("model_of", op.target, op.model).put("created_at", op.target, at)


def _unmark_instance(spark, state, op, schemas, at):
    rows = state.instances[op.target]
    return _drop_instance(spark, state, op, schemas, at).put("multi", op.target, rows)


def _seed(part: str) -> tuple[Callable, Callable]:
    def names(state, op, at):
        return _instances(state, op.target, at) if op.kind == "seed_models_type" else [op.target]

    def types(state, op, schemas, name):
        return schemas.collections[name] if part == "collections" else schemas.multi[name][op.type_name] if part == "multi" else schemas.models[state.model_of[name]][op.type_name]

    def apply(spark, state, op, schemas, at):
        for name in names(state, op, at):
            rows = _rows(spark, op.docs, types(state, op, schemas, name), op.type_name)
            state = state.put(part, name, _together(getattr(state, part)[name], rows))
        return state

    def reverse(spark, state, op, schemas, at):
        ids = [d["_id"] for d in op.docs if "_id" in d]
        for name in names(state, op, at):
            df = getattr(state, part)[name]
            if len(ids) == len(op.docs):
                gone = F.col("_id").isin(ids)
            else:  # documents without ids of their own are known by their values
                own = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in d.items() if not isinstance(v, (dict, list))], F.lit(True)) for d in op.docs]
                gone = reduce(lambda a, b: a | b, own, F.lit(False))
            gone = gone & (F.col(TYPE) == op.type_name) if op.type_name else gone
            state = state.put(part, name, df.where(~F.coalesce(gone, F.lit(False))))
        return state

    return apply, reverse


def _transform(part: str) -> tuple[Callable, Callable]:
    def run(state, op, at, change):
        names = _instances(state, op.target, at) if op.kind == "transform_models_type" else [op.target]
        for name in names:
            df = getattr(state, part).get(name)
            if df is None:
                raise MigrationError(f"no {part} {name}")
            state = state.put(part, name, change(df) if op.type_name is None else _on_type(df, op.type_name, change))
        return state

    def apply(spark, state, op, schemas, at):
        return run(state, op, at, op.up)

    def reverse(spark, state, op, schemas, at):
        if op.irreversible or op.down is None:
            raise MigrationError(f"the transform of {op.target} can't be reversed")
        return run(state, op, at, op.down)

    return apply, reverse


def _over(op: Operation, state: State, at: str, change: Callable[[DataFrame], DataFrame]) -> State:
    part = "instances" if op.kind.endswith("models_type") else "multi"
    for name in _instances(state, op.target, at) if part == "instances" else [op.target]:
        state = state.put(part, name, change(getattr(state, part)[name]))
    return state


def _delete_type(spark, state, op, schemas, at):
    return _over(op, state, at, lambda df: df.where(F.col(TYPE) != op.type_name))


def _never(spark, state, op, schemas, at):
    raise MigrationError(f"{op.kind} of {op.target} can't be reversed")


def _rename(forward: bool) -> Callable:
    def run(spark, state, op, schemas, at):
        old, new = (op.type_name, op.new_type) if forward else (op.new_type, op.type_name)
        return _over(op, state, at, lambda df: _renamed(df, old, new, op.kind == "rename_models_type"))

    return run


def _same(spark, state, op, schemas, at):
    return state


#: Operation -> (apply, reverse).
OPERATIONS: dict[str, tuple[Callable, Callable]] = {
    "create_collection": (_create_collection, lambda spark, state, op, schemas, at: state.drop("collections", op.target)),
    "create_multi": (_create_multi, lambda spark, state, op, schemas, at: state.drop("multi", op.target)),
    "create_instance": (_create_instance, _drop_instance),
    "mark_instance": (_mark_instance, _unmark_instance),
    "seed_collection": _seed("collections"),
    "seed_multi_type": _seed("multi"),
    "seed_instance_type": _seed("instances"),
    "seed_models_type": _seed("instances"),
    "transform_collection": _transform("collections"),
    "transform_multi_type": _transform("multi"),
    "transform_instance_type": _transform("instances"),
    "transform_models_type": _transform("instances"),
    "update_indexes": (_same, _same),
    "delete_multi_type": (_delete_type, _never),
    "delete_models_type": (_delete_type, _never),
    "rename_multi_type": (_rename(True), _rename(False)),
    "rename_models_type": (_rename(True), _rename(False)),
}


def apply(spark: SparkSession, state: State, m: Migration, only: str | None = None) -> State:
    """The state after a migration. With only, operations on instances touch that one alone (catch-up)."""
    for op in operations_of(m).operations:
        if only is not None:
            if op.kind.endswith("models_type"):
                model = state.model_of.get(only)
                if model == op.target:
                    one = replace(state, model_of={only: model})
                    after = OPERATIONS[op.kind][0](spark, one, op, m.schemas, m.id)
                    state = replace(after, model_of=state.model_of)
            elif op.target == only and op.kind in ("seed_instance_type", "transform_instance_type"):
                state = OPERATIONS[op.kind][0](spark, state, op, m.schemas, m.id)
            continue
        state = OPERATIONS[op.kind][0](spark, state, op, m.schemas, m.id)
    return state


def reverse(spark: SparkSession, state: State, m: Migration) -> State:
    """The state before a migration, by its operations from last to first."""
    for op in reversed(operations_of(m).operations):
        state = OPERATIONS[op.kind][1](spark, state, op, m.schemas, m.id)
    return state


# --- conformance and simulation


def problems(state: State, schemas: Schemas) -> list[str]:
    """Tables that are missing, and counts of documents that do not conform."""
    out = []
    for name, schema in schemas.collections.items():
        df = state.collections.get(name)
        if df is None:
            out.append(f"collection {name} is declared but was not created")
        elif bad := df.where(~schema.valid(df.schema) | F.lit(bool(set(df.columns) - set(row_schema(schema).names)))).count():
            out.append(f"collection {name}: {bad} documents do not conform")
    typed = [(n, state.multi.get(n), t) for n, t in schemas.multi.items()] + [(n, state.instances[n], schemas.models.get(m, {})) for n, m in state.model_of.items()]
    for name, df, types in typed:
        if df is None:
            out.append(f"store {name} is declared but was not created")
            continue
        good = reduce(lambda a, b: a | b, [(F.col(TYPE) == k) & s.valid(df.schema) for k, s in types.items()], F.lit(False))
        if bad := df.where(~F.coalesce(good, F.lit(False))).count():
            out.append(f"store {name}: {bad} documents do not conform")
    return out


POWER = {"quick": 10, "normal": 100, "hard": 500}


def mock(node: Node, r: random.Random, depth: int = 0) -> Any:
    """A value that conforms to a schema."""
    limits = dict(node.checks)
    if isinstance(node, Wrapped):
        return None if node.mode != "optional" and r.random() < 0.2 or node.mode == "optional" and node.default is None and r.random() < 0.3 else mock(node.inner, r, depth)
    if isinstance(node, OneOf):
        return r.choice(node.values)
    if isinstance(node, Array):
        return [mock(node.item, r, depth + 1) for _ in range(r.randint(limits.get("min_length", 0), max(limits.get("min_length", 0), min(3, limits.get("max_length", 3)))))]
    if isinstance(node, MapOf):
        return {f"key{i}": mock(node.value, r, depth + 1) for i in range(r.randint(0, 2))}
    if isinstance(node, Object):
        return {k: mock(v, r, depth + 1) for k, v in node.fields.items()}
    if isinstance(node, Union):
        return mock(r.choice(node.options), r, depth + 1)
    assert isinstance(node, Scalar)
    if node.name in ("number", "integer"):
        low = limits.get("min_value", 0)
        value = r.randint(int(low), int(limits.get("max_value", low + 1000)))
        return value if node.name == "integer" else float(value)
    if node.name == "bool":
        return r.random() < 0.5
    if node.name == "date":
        import datetime as dt

        return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=r.randint(0, 10**8))
    if node.name == "null":
        return None
    pattern = limits.get("pattern")
    if pattern:
        for sample in ("someone@example.com", "abc", "ABC123", "12345", "doc:1a", "https://example.com"):
            import re

            if re.search(pattern if isinstance(pattern, str) else pattern.pattern, sample):
                return sample
    size = limits.get("length") or max(limits.get("min_length", 3), min(8, limits.get("max_length", 8)))
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))


def mock_state(spark: SparkSession, schemas: Schemas, n: int, seed: int = 0, instances: Mapping[str, str] | None = None) -> State:
    r = random.Random(seed)
    state = State()
    for name, schema in schemas.collections.items():
        state = state.put("collections", name, _rows(spark, [mock(schema, r) for _ in range(n)], schema, None))
    typed = [("multi", k, t) for k, t in schemas.multi.items()] + [("instances", k, schemas.models[m]) for k, m in (instances or {}).items()]
    for part, name, types in typed:
        df = _empty(spark, types)
        for kind, schema in types.items():
            docs = [{**mock(schema, r), "_id": prefixed_id(kind)} for _ in range(n)]
            df = df.unionByName(_rows(spark, docs, schema, kind), allowMissingColumns=True)
        state = state.put(part, name, df)
        if part == "instances":
            state = state.put("model_of", name, instances[name])
    return state


def simulate(spark: SparkSession, m: Migration, power: str = "quick", state: State | None = None, seed: int = 0) -> dict[str, Any]:
    """Apply a migration to mock data, check the result, reverse it and check that: errors, warnings, and the state reached."""
    parent = m.parent.schemas if m.parent else Schemas()
    given = state
    if state is None:
        models = {}
        for x in [m.parent] if m.parent else []:
            models = {o.target: o.model for a in _line(x) for o in operations_of(a).operations if o.kind in ("create_instance", "mark_instance")}
        state = mock_state(spark, parent, POWER[power], seed, models)
    errors, warnings = [], []
    try:
        after = apply(spark, state, m)
        errors += problems(after, m.schemas)
    except Exception as e:  # whatever a transform raises is what the simulation is for
        return {"id": m.id, "errors": [f"{type(e).__name__}: {e}"], "warnings": warnings, "state": given}
    built = operations_of(m)
    if built.summary()["irreversible"]:
        warnings.append("the migration can't be reversed")
    elif not errors:
        try:
            back = reverse(spark, after, m)
            errors += [f"after the rollback: {p}" for p in problems(back, parent)]
            warnings += _unlike(state, back)
        except Exception as e:
            errors.append(f"rollback: {type(e).__name__}: {e}")
    return {"id": m.id, "errors": errors, "warnings": warnings, "state": after}


def _line(m: Migration) -> list[Migration]:
    from docloom.migrate.model import path_to

    return path_to(m)


def _unlike(a: State, b: State) -> list[str]:
    """Tables whose rows a rollback doesn't restore."""
    out = []
    for part in ("collections", "multi", "instances"):
        for name, old in getattr(a, part).items():
            new = getattr(b, part).get(name)
            if new is None:
                out.append(f"{name} is gone after the rollback")
                continue
            columns = sorted(set(old.columns) & set(new.columns))
            left, right = old.select(columns), new.select([F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns])
            if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
                out.append(f"{name} differs after the rollback")
    return out


def _next_state(spark: SparkSession, state: State, schemas: Schemas, models: Iterable[str], n: int, seed: int) -> tuple[State, list[str]]:
    """What the next migration meets: every second row of each table and n mock rows (of each type) more, and the tables that can't have any.

    Each of `models` without an instance gets one of mock rows.
    """
    warnings: list[str] = []

    def kept(df: DataFrame) -> DataFrame:  # as values, so that chains stay cheap and every read sees the same rows
        return spark.createDataFrame(df.collect()[::2], df.schema)

    def more(part: str, name: str, own: Schemas, instances: Mapping[str, str] | None = None) -> None:
        nonlocal state
        old = getattr(state, part).get(name)
        old = None if old is None else kept(old)
        try:
            rows = getattr(mock_state(spark, own, n, seed, instances), part)[name]
            rows = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        except Exception as e:  # a pattern, say, that no mock value meets
            warnings.append(f"{name} gets no mock rows: {type(e).__name__}: {e}")
            rows = old
        if rows is not None:
            state = state.put(part, name, rows)
            if part == "instances" and name not in state.model_of:
                state = state.put("model_of", name, instances[name])

    wanted = set(models)
    for name, model in list(state.model_of.items()):
        if name == f"mock:{model}" and model not in wanted:
            state = state.drop("instances", name).drop("model_of", name)
    for name, schema in schemas.collections.items():
        more("collections", name, Schemas(collections={name: schema}))
    for name, types in schemas.multi.items():
        more("multi", name, Schemas(multi={name: types}))
    own = {**state.model_of, **{f"mock:{m}": m for m in schemas.models if m in wanted and m not in state.model_of.values()}}
    for name, model in own.items():
        if model in schemas.models:
            more("instances", name, Schemas(models={model: schemas.models[model]}), {name: model})
    return state, warnings


def simulate_all(spark: SparkSession, migrations: list[Migration], power: str = "quick") -> list[dict[str, Any]]:
    """Each migration on half of the rows that those before it have left and POWER[power] mock rows of each declared table or type."""
    out: list[dict[str, Any]] = []
    state = None if migrations and migrations[0].parent else State()
    for i, m in enumerate(migrations):
        noted: list[str] = []
        if out:
            state, noted = _next_state(spark, out[-1]["state"], migrations[i - 1].schemas, m.schemas.models, POWER[power], i)
        out.append(simulate(spark, m, power, state))
        out[-1]["warnings"][:0] = noted
        if out[-1]["errors"]:
            break
    return out


# --- on a store

LOG = "_migration_log"
LOG_SCHEMA = "migration string, name string, operation string, target string, at timestamp, seconds double, error string"
REGISTRY = "_instances"


def state_of(store: Store) -> State:
    state = State()
    for name, entry in store.tables().items():
        about = entry.get("about", {})
        if name.startswith("_"):
            continue
        df = store.read(name)
        if about.get("model"):
            state = state.put("instances", name, df).put("model_of", name, about["model"]).put("created_at", name, about.get("created", "unknown"))
        else:
            state = state.put("multi" if entry["typed"] else "collections", name, df)
    return state


def save(store: Store, before: State, after: State) -> None:
    """Write what has changed, in the unit of work at hand."""
    for part, typed in (("collections", False), ("multi", True), ("instances", True)):
        for name, df in getattr(after, part).items():
            marked = part == "instances" and name in before.multi
            if getattr(before, part).get(name) is not df and not (marked and before.multi[name] is df):
                store.write(name, df, typed=typed)
                if df.isEmpty() and typed:
                    store.create(name, df.schema, typed=True, exist_ok=True)
        for name in getattr(before, part):
            if name not in after.collections and name not in after.multi and name not in after.instances:
                store.drop(name)
    for name in {*before.model_of, *after.model_of}:
        if name in store.tables():
            store.about(name, model=after.model_of.get(name), created=after.created_at.get(name))


def log_entries(store: Store, m: Migration, operation: str, seconds: float, error: str | None = None, targets: Iterable[str | None] = (None,)) -> None:
    """One row for the migration itself (None) and for each instance, written together."""
    import datetime as dt

    if LOG not in store.tables():
        store.create(LOG, T._parse_datatype_string(LOG_SCHEMA))
    now = dt.datetime.now()
    store.append(LOG, store.spark.createDataFrame([(m.id, m.name, operation, t, now, seconds, error) for t in targets], LOG_SCHEMA).coalesce(1))


def log_entry(store: Store, m: Migration, operation: str, seconds: float, error: str | None = None, target: str | None = None) -> None:
    log_entries(store, m, operation, seconds, error, [target])


def _apply_indexes(store: Store, m: Migration) -> None:
    """update_indexes, in the unit of work at hand: keys are tested against the schemas of the migration, which are noted with the table."""
    for op in operations_of(m).operations:
        if op.kind == "update_indexes":
            model = store.about(op.target).get("model") if op.target in store.tables() else None
            schema = m.schemas.collections.get(op.target) or m.schemas.multi.get(op.target) or m.schemas.models.get(model)
            if schema is None:
                raise MigrationError(f"{op.target} has no schema in {m.id}")
            apply_constraints(store, op.target, schema)


def history(store: Store) -> DataFrame:
    if LOG not in store.tables():
        return store.spark.createDataFrame([], LOG_SCHEMA)
    return store.read(LOG)


def fold_log(log: DataFrame, key: str = "migration", operation: str = "operation", at: str = "at", error: str | None = "error") -> DataFrame:
    """migration, state: the last operation that succeeded; failed where none did."""
    good = F.col(operation) != "failed"
    good = good & F.col(error).isNull() if error else good
    return log.groupBy(key).agg(F.coalesce(F.max_by(F.when(good, F.col(operation)), F.when(good, F.col(at))), F.lit("failed")).alias("state"))


def states(store: Store) -> dict[str, str]:
    return {r.migration: r.state for r in fold_log(history(store).where("target is null")).collect()}


def pending(store: Store, migrations: list[Migration]) -> list[Migration]:
    done = states(store)
    return [m for m in migrations if done.get(m.id) != "applied"]


def migrate(store: Store, m: Migration) -> None:
    """Apply a migration and note it, in one commit; a failure is noted in another."""
    _run(store, m, "applied", lambda s: apply(store.spark, s, m), m.schemas)


def rollback(store: Store, m: Migration) -> None:
    _run(store, m, "reverted", lambda s: reverse(store.spark, s, m), m.parent.schemas if m.parent else Schemas())


def _run(store: Store, m: Migration, operation: str, change: Callable[[State], State], schemas: Schemas) -> None:
    began = time.time()
    try:
        with store.unit_of_work():
            before = state_of(store)
            after = change(before)
            if bad := problems(after, schemas):
                raise MigrationError("; ".join(bad))
            save(store, before, after)
            took = time.time() - began
            log_entries(store, m, operation, took, targets=[None, *(n for n, model in after.model_of.items() if touches(m, n, model))])
            if operation == "applied":
                _apply_indexes(store, m)
    except Exception as e:
        log_entry(store, m, "failed", time.time() - began, f"{type(e).__name__}: {e}")
        raise


def touches(m: Migration, name: str, model: str) -> bool:
    """Whether a migration has an operation on an instance or on its model."""
    return any(o.target in (model, name) for o in operations_of(m).operations)


def catch_up_needed(store: Store, migrations: list[Migration]) -> dict[str, dict[str, Any]]:
    """For each instance: the migrations that are applied in general and concern it, but are not applied to it; orphaned without any history."""
    state, done = state_of(store), states(store)
    own = {(r.target, r.migration): r.state for r in fold_log(history(store).where("target is not null").withColumn("pair", F.struct("target", "migration")), "pair").select("pair.target", "pair.migration", "state").collect()}
    out = {}
    for name, model in state.model_of.items():
        concerned = [m for m in migrations if done.get(m.id) == "applied" and concerns(m, state.created_at.get(name, "unknown"), migrations) and touches(m, name, model)]
        missing = [m.id for m in concerned if own.get((name, m.id)) != "applied" and m.id != state.created_at.get(name)]
        out[name] = {"missing": missing, "orphaned": not any(t == name for t, _ in own)}
    return out


def catch_up(store: Store, name: str, migrations: list[Migration]) -> list[str]:
    """Apply what one instance has missed, to it alone."""
    missing = catch_up_needed(store, migrations)[name]["missing"]
    for m in (m for m in migrations if m.id in missing):
        with store.unit_of_work():
            before = state_of(store)
            save(store, before, apply(store.spark, before, m, only=name))
            log_entry(store, m, "applied", 0.0, target=name)
    return missing


def status(store: Store | None, migrations: list[Migration], declared: Schemas | None = None, spark: SparkSession | None = None, power: str = "quick") -> dict[str, Any]:
    """errors, pending, states, catch_up and healthy."""
    from docloom.migrate.model import check_chain, check_project

    chain = check_chain(migrations)
    errors = list(chain["errors"])
    if declared is not None and migrations:
        errors += check_project(declared, chain["order"][-1])
    if spark is not None:
        for r in simulate_all(spark, chain["order"], power):
            errors += [f"{r['id']}: {e}" for e in r["errors"]]
    waiting = [m.id for m in pending(store, chain["order"])] if store else []
    return {"errors": errors, "pending": waiting, "states": states(store) if store else {}, "catch_up": catch_up_needed(store, chain["order"]) if store else {}, "healthy": not errors and not waiting}
