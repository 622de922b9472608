"""Aggregation stages: a list of them is folded over a DataFrame.

A peephole pass over the list comes first: a lookup that is unwound at once is an inner join, one that only
asks whether there was a match is a semi or anti join, and one whose matches are only counted counts them, so that no array of matches is built.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.expressions import Scope, compile_expression, truth
from docloom.functions.filters import compile_filter
from docloom.functions.paths import quoted, value_at

TYPE = "_type"


@dataclass
class Context:
    """Where stages find other tables: `own` is the table itself, `tables` the others by name."""

    own: DataFrame
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    variables: Mapping[str, Column] = field(default_factory=dict)


def unused(df: DataFrame, *more: Any) -> list[str]:
    """Names (the last arguments) with underscores added until neither df has such columns nor the stages before the names mention them."""
    given = [m for m in more if not isinstance(m, str)]
    taken, text, out = {c.lower() for c in df.columns}, json.dumps([_plain(s) for g in given for s in g], default=str), []
    for name in (m for m in more if isinstance(m, str)):
        while name.lower() in taken or name in text:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Stage:
    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Match(Stage):
    spec: Any

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return df.where(compile_filter(self.spec, df.schema, context.variables))


@dataclass(frozen=True)
class Unwind(Stage):
    """One row for each element; a value that isn't an array is its own one element."""

    path: str
    keep_empty: bool = False
    index: str | None = None

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        head, _, rest = self.path.partition(".")
        value = value_at(df.schema, self.path)
        kind = df.select(value.alias("v")).schema["v"].dataType
        if not isinstance(kind, T.ArrayType):
            return df if self.keep_empty else df.where(value.isNotNull())
        names = df.columns
        at, one = unused(df, "_at", "_item")
        spread = df.select("*", (F.posexplode_outer if self.keep_empty else F.posexplode)(value).alias(at, one))
        item = F.col(one) if not rest else quoted(head).withField(rest, F.col(one))
        out = [item.alias(c) if c == head else quoted(c) for c in names]
        return spread.select(*out, *([F.col(at).cast("long").alias(self.index)] if self.index else []))


@dataclass(frozen=True)
class Lookup(Stage):
    """A left join whose matches become an array. source None is the table itself; of_type keeps foreign documents of one type."""

    local: str | None
    foreign: str | None
    to: str
    source: str | None = None
    of_type: str | None = None
    let: Mapping[str, Any] = field(default_factory=dict)
    pipeline: tuple[Stage, ...] = ()
    mode: str = "array"  # or inner, outer, semi, anti, count: set by the peephole pass
    null_keys: bool = False  # whether null keys match each other; else they match nothing, and never become one hot key

    def _foreign(self, context: Context) -> DataFrame:
        df = context.own if self.source is None else context.tables[self.source]
        return df.where(F.col(TYPE) == self.of_type) if self.of_type else df

    def _prepared(self, context: Context) -> DataFrame:
        """The foreign rows as structs `_doc` with their join keys `_key`; the sub-pipeline is applied within each key."""
        df = self._foreign(context)
        df = df.withColumn("_key", value_at(df.schema, self.foreign))
        inner = replace(context, own=context.own)
        for stage in self.pipeline:
            if isinstance(stage, (Sort, Skip, Limit, Group, Count)):
                df = _per_key(stage, df)
            elif isinstance(stage, Project):
                df = stage.apply(df.withColumnRenamed("_key", "_kept"), inner, ("_kept",)).withColumnRenamed("_kept", "_key")
            else:
                df = stage.apply(df, inner)
        hidden = ("_key", "_rank")
        return df.select("_key", *(["_rank"] if "_rank" in df.columns else []), F.struct(*(quoted(c) for c in df.columns if c not in hidden)).alias("_doc"))

    def _same(self, a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b)) if self.null_keys else F.col(a) == F.col(b)

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        if self.let or self.foreign is None:
            return self._correlated(df, context)
        names, right = [c for c in df.columns if c != self.to], self._prepared(context)
        local = value_at(df.schema, self.local)
        kind = df.select(local.alias("v")).schema["v"].dataType
        if isinstance(kind, T.ArrayType):
            return self._by_elements(df, right, local, names)
        (own,) = unused(df, "_local")
        hidden = [c for c in ("_key", "_doc", "_docs", "_rank") if c in df.columns]
        right = right.withColumnsRenamed({c: f"{c}_of_lookup" for c in hidden}) if hidden else right
        return self._joined(df.withColumn(own, local), right, own, names, {c: f"{c}_of_lookup" if c in hidden else c for c in ("_key", "_doc", "_docs", "_rank")})

    def _joined(self, left: DataFrame, right: DataFrame, own: str, names: list[str], called: dict[str, str]) -> DataFrame:
        key, doc, docs = called["_key"], called["_doc"], called["_docs"]
        same = self._same(own, key)
        if self.mode in ("semi", "anti"):
            return left.join(right.select(key), same, f"left_{self.mode}").drop(own)
        if self.mode in ("inner", "outer"):
            joined = left.join(right, same, "inner" if self.mode == "inner" else "left")
            return joined.select(*(quoted(c) for c in names), F.col(doc).alias(self.to))
        if self.mode == "count":
            grouped = right.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(docs))
            return left.join(grouped, same, "left").select(*(quoted(c) for c in names), F.coalesce(docs, F.lit(0)).alias(self.to))
        grouped = right.groupBy(key).agg(_collected(right, called).alias(docs))
        joined = left.join(grouped, same, "left")
        return joined.select(*(quoted(c) for c in names), _or_empty(F.col(docs), right, doc).alias(self.to))

    def _by_elements(self, df: DataFrame, right: DataFrame, local: Column, names: list[str]) -> DataFrame:
        """A local array matches by any element; each foreign row once. Matches depend on the array alone, which is the key that brings them back."""
        (of,) = unused(df, "_of")
        rows = df.withColumn(of, local)
        keys = rows.select(F.col(of).alias("_array")).distinct().select("_array", F.explode(F.array_distinct("_array")).alias("_local"))
        pairs = keys.join(right, self._same("_local", "_key"))
        found = self._brought_back(rows, pairs.drop("_local", "_key"), F.col(of) == F.col("_array"), "_array", df.columns, names)
        return found

    def _brought_back(self, rows: DataFrame, docs: DataFrame, same: Column, by: str, columns: list[str], names: list[str]) -> DataFrame:
        """Each row's documents `_doc` of docs, whose column `by` tells what they belong to."""
        if self.mode in ("semi", "anti"):
            return rows.join(docs.select(by).distinct(), same, f"left_{self.mode}").select(*(quoted(c) for c in columns))
        if self.mode in ("inner", "outer"):
            return rows.join(docs, same, "inner" if self.mode == "inner" else "left").select(*(quoted(c) for c in names), F.col("_doc").alias(self.to))
        if self.mode == "count":
            grouped = docs.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("_docs"))
            return rows.join(grouped, same, "left").select(*(quoted(c) for c in names), F.coalesce("_docs", F.lit(0)).alias(self.to))
        grouped = docs.groupBy(by).agg(_collected(docs).alias("_docs"))
        return rows.join(grouped, same, "left").select(*(quoted(c) for c in names), _or_empty(F.col("_docs"), docs).alias(self.to))

    def _correlated(self, df: DataFrame, context: Context) -> DataFrame:
        """Variables of the local row in a sub-pipeline: its leading matches are the join's condition.

        Matches depend on the values of the variables (and of the local field) alone: these, distinct, are joined, and are the key that brings matches back.
        """
        outer = Scope(df.schema, context.variables)
        (of,) = unused(df, "_given")
        values = [compile_expression(v, outer).alias(k) for k, v in self.let.items()]
        own = [value_at(df.schema, self.local).alias("_local")] if self.foreign is not None else []
        rows = df.withColumn(of, F.struct(*values, *own) if values or own else F.struct(F.lit(1).alias("_none")))
        left, right = rows.select(F.col(of).alias("_let")).distinct(), self._foreign(context)
        if self.foreign is not None:
            right = right.withColumn("_key", value_at(right.schema, self.foreign))
        leading = []
        rest = list(self.pipeline)
        while rest and isinstance(rest[0], Match):
            leading.append(rest.pop(0))
        if any("$$" in json.dumps(_plain(s), default=str) for s in rest):
            raise ValueError("variables of a lookup are understood in the leading matches of its pipeline")
        renamed = right.select(*(quoted(c).alias(f"_f_{c}") for c in right.columns))
        variables = dict(context.variables) | {k: F.col("_let").getField(k) for k in self.let}
        inner = _Renamed(right.schema)
        condition = reduce(lambda a, b: a & b, [_match_renamed(s.spec, inner, variables) for s in leading], F.lit(True))
        if self.foreign is not None:
            local, key = F.col("_let").getField("_local"), F.col("_f__key")
            condition = (local.eqNullSafe(key) if self.null_keys else local == key) & condition
        hidden = {"_key"} if self.foreign is not None else set()
        pairs = left.join(renamed, condition)
        pairs = pairs.select(F.col("_let").alias("_key"), *(F.col(f"`_f_{c}`").alias(c) for c in right.columns if c not in hidden))
        for stage in rest:
            if isinstance(stage, (Sort, Skip, Limit, Group, Count)):
                pairs = _per_key(stage, pairs)
            elif isinstance(stage, Project):
                pairs = stage.apply(pairs.withColumnRenamed("_key", "_kept"), context, ("_kept",)).withColumnRenamed("_kept", "_key")
            else:
                pairs = stage.apply(pairs, context)
        docs = pairs.select(F.col("_key").alias("_of"), *(["_rank"] if "_rank" in pairs.columns else []), F.struct(*(quoted(c) for c in pairs.columns if c not in ("_key", "_rank"))).alias("_doc"))
        names = [c for c in df.columns if c != self.to]
        return self._brought_back(rows, docs, F.col(of).eqNullSafe(F.col("_of")), "_of", df.columns, names)


class _Renamed(T.StructType):
    """A schema whose columns carry a prefix in the joined row."""

    def __init__(self, schema: T.StructType):
        super().__init__([T.StructField(f"_f_{f.name}", f.dataType) for f in schema.fields])


def _prefixed(value: Any, names: set[str]) -> Any:
    """The paths of an expression or filter, with the prefix of the joined row."""
    if isinstance(value, str) and value.startswith("$") and not value.startswith("$$"):
        return "$_f_" + value[1:]
    if isinstance(value, dict):
        return {k if k == "$literal" else k: (v if k == "$literal" else _prefixed(v, names)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_prefixed(v, names) for v in value]
    return value


def _match_renamed(spec: Mapping[str, Any], schema: T.StructType, variables: Mapping[str, Column]) -> Column:
    names = set(schema.names)
    out = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [_match_renamed(v, schema, variables) for v in value]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
            out.append(~joined if key == "$nor" else joined)
        elif key == "$expr":
            out.append(truth(_prefixed(value, names), Scope(schema, variables)))
        else:
            out.append(compile_filter({f"_f_{key}": value}, schema, variables))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def _collected(rows: DataFrame, called: Mapping[str, str] | None = None) -> Column:
    rank, doc = (called or {}).get("_rank", "_rank"), (called or {}).get("_doc", "_doc")
    if rank not in rows.columns:
        return F.collect_list(doc)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_rank"), F.col(doc).alias("_doc"))), lambda a, b: (a["_rank"] - b["_rank"]).cast("int")), lambda x: x["_doc"])


def _or_empty(docs: Column, rows: DataFrame, doc: str = "_doc") -> Column:
    return F.coalesce(docs, F.array().cast(T.ArrayType(rows.schema[doc].dataType)))


def _per_key(stage: Stage, df: DataFrame) -> DataFrame:
    """Order, skip, limit, group and count of a sub-pipeline hold within the matches of one local row."""
    if isinstance(stage, Sort):
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*stage.order(df.schema))))
    if isinstance(stage, (Skip, Limit)):
        if "_rank" not in df.columns:
            df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1))))
        if isinstance(stage, Limit):
            return df.where(F.col("_rank") <= stage.n)
        return df.where(F.col("_rank") > stage.n).withColumn("_rank", F.col("_rank") - stage.n)
    if isinstance(stage, Count):
        return df.groupBy("_key").agg(F.count("*").alias(stage.to))
    return stage.grouped(df, ["_key"])


@dataclass(frozen=True)
class Project(Stage):
    spec: Mapping[str, Any]

    def apply(self, df: DataFrame, context: Context, keep: tuple[str, ...] = ()) -> DataFrame:
        spec, scope = dict(self.spec), Scope(df.schema, context.variables)
        with_id = bool(spec.pop("_id", 1)) if not isinstance(self.spec.get("_id", 1), (str, dict)) else True
        drop = [k for k, v in spec.items() if v is False or (isinstance(v, int) and v == 0)]
        if drop and len(drop) < len(spec):
            raise ValueError("a projection includes or excludes, not both")
        if drop or not spec and not (with_id and "_id" in self.spec):
            out = df.drop(*(k for k in drop if "." not in k), *([] if with_id else ["_id"]))
            for path in (k for k in drop if "." in k):
                head, _, rest = path.partition(".")
                out = out.withColumn(head, quoted(head).dropFields(rest))
            return out
        columns = [quoted(k) for k in keep]
        if isinstance(self.spec.get("_id"), (str, dict)):
            columns.append(compile_expression(self.spec["_id"], scope).alias("_id"))
        elif with_id and "_id" in df.columns:
            columns.append(quoted("_id"))
        nested: dict[str, list[Column]] = {}
        for key, value in spec.items():
            column = value_at(df.schema, key) if value is True or value == 1 and not isinstance(value, str) else compile_expression(value, scope)
            head, _, rest = key.partition(".")
            if rest:
                nested.setdefault(head, []).append(column.alias(rest))
            else:
                columns.append(column.alias(key))
        return df.select(*columns, *(F.struct(*parts).alias(head) for head, parts in nested.items()))


@dataclass(frozen=True)
class AddFields(Stage):
    spec: Mapping[str, Any]

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        scope, plain = Scope(df.schema, context.variables), {}
        for key, value in self.spec.items():
            column = compile_expression(value, scope)
            head, _, rest = key.partition(".")
            if not rest:
                plain[key] = column
            else:
                base = plain.get(head, quoted(head) if head in df.columns else None)
                plain[head] = base.withField(rest, column) if base is not None else reduce(lambda c, name: F.struct(c.alias(name)), reversed(rest.split(".")), column)
        return df.withColumns(plain)


_ACCUMULATORS: dict[str, Callable[[Column], Column]] = {
    "$sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "$avg": F.avg,
    "$min": F.min,
    "$max": F.max,
    "$first": F.first,
    "$last": F.last,
    "$push": F.collect_list,
    "$addToSet": F.collect_set,
    "$stdDevPop": F.stddev_pop,
    "$stdDevSamp": F.stddev_samp,
}


def _ranked(op: str, value: Column, rank: str) -> Column:
    """$first, $last and $push by the rank of rows in their group."""
    if op == "$push":
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), value.alias("v")))), lambda x: x["v"])
    return (F.min_by if op == "$first" else F.max_by)(value, F.col(rank))


@dataclass(frozen=True)
class Group(Stage):
    """order: what a sort right before it says, which then holds for $first, $last and $push; without one they take rows as they come."""

    spec: Mapping[str, Any]
    order: Any = None

    @property
    def by_order(self) -> bool:
        return any(k != "_id" and set(v) & {"$first", "$last", "$push"} for k, v in self.spec.items())

    def grouped(self, df: DataFrame, by: list[str]) -> DataFrame:
        rank = None
        if self.order is not None and self.by_order:
            (rank,) = unused(df, "_rank")
            keys = [*by, compile_expression(self.spec["_id"], Scope(df.schema))]
            df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*Sort(self.order).order(df.schema))))
        scope = Scope(df.schema)
        key = compile_expression(self.spec["_id"], scope)
        outs = []
        for name, acc in self.spec.items():
            if name == "_id":
                continue
            (op, argument), = acc.items()
            if op == "$count":
                outs.append(F.count(F.lit(1)).alias(name))
            elif rank is not None and op in ("$first", "$last", "$push"):
                outs.append(_ranked(op, compile_expression(argument, scope), rank).alias(name))
            elif op in _ACCUMULATORS:
                outs.append(_ACCUMULATORS[op](compile_expression(argument, scope)).alias(name))
            else:
                raise ValueError(f"unknown accumulator {op}")
        rows = df.groupBy(*by, key.alias("_id"))
        return rows.agg(*outs) if outs else rows.agg(F.count(F.lit(1)).alias("_n")).drop("_n")

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return self.grouped(df, [])


@dataclass(frozen=True)
class Sort(Stage):
    """Nulls come first ascending and last descending."""

    spec: Mapping[str, Any]

    def order(self, schema: T.StructType) -> list[Column]:
        return [value_at(schema, k).asc_nulls_first() if v in (1, "asc", "ascending") else value_at(schema, k).desc_nulls_last() for k, v in self.spec.items()]

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return df.orderBy(*self.order(df.schema))


@dataclass(frozen=True)
class Limit(Stage):
    n: int

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return df.limit(self.n)


@dataclass(frozen=True)
class Skip(Stage):
    n: int

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return df.offset(self.n)


@dataclass(frozen=True)
class Count(Stage):
    to: str = "count"

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(self.to))


def _plain(stage: Any) -> Any:
    return {k: ([_plain(s) for s in v] if k == "pipeline" else v) for k, v in vars(stage).items()} if isinstance(stage, Stage) else stage


def _mentions(stages: list[Stage], name: str) -> bool:
    """Whether `name` is read before a stage that leaves only what it names."""
    for stage in stages:
        if isinstance(stage, Count):
            return False
        if name in json.dumps(_plain(stage), default=str):
            return True
        if isinstance(stage, Group) or isinstance(stage, Project) and not all(v in (0, False) for v in stage.spec.values()):
            return False
    return True


def _asks_for_match(stage: Stage, to: str) -> str | None:
    """semi or anti, if a match asks only whether the array `to` has elements."""
    if not isinstance(stage, Match) or not isinstance(stage.spec, Mapping) or len(stage.spec) != 1:
        return None
    (key, value), = stage.spec.items()
    if key == to and value in ({"$size": 0}, {"$eq": []}, []):
        return "anti"
    if key == to and value == {"$ne": []} or key == f"{to}.0" and value == {"$exists": True}:
        return "semi"
    return "anti" if key == f"{to}.0" and value == {"$exists": False} else None


def _counts_only(stage: Stage | None, to: str) -> Stage | None:
    """The projection with numbers in place of the array's size, if it reads nothing else of the array `to`."""
    if not isinstance(stage, Project) or all(v in (0, False) for v in stage.spec.values()):
        return None

    def counted(value: Any) -> Any:
        if value == {"$size": f"${to}"}:
            return f"${to}"
        return {k: counted(v) for k, v in value.items()} if isinstance(value, dict) else [counted(v) for v in value] if isinstance(value, list) else value

    marked = json.dumps(stage.spec, default=str)
    sizes = marked.count(json.dumps({"$size": f"${to}"}))
    return Project(counted(stage.spec)) if sizes and marked.count(f"${to}") == sizes and to not in stage.spec else None


def optimized(stages: list[Stage]) -> list[Stage]:
    out, i = [], 0
    while i < len(stages):
        stage, follower = stages[i], stages[i + 1] if i + 1 < len(stages) else None
        if isinstance(stage, Lookup) and stage.mode == "array":
            if isinstance(follower, Unwind) and follower.path == stage.to and follower.index is None:
                out.append(replace(stage, mode="outer" if follower.keep_empty else "inner"))
                i += 2
                continue
            asked = _asks_for_match(follower, stage.to) if follower else None
            if asked and not _mentions(stages[i + 2 :], stage.to):
                out.append(replace(stage, mode=asked))
                i += 2
                continue
            if numbers := _counts_only(follower, stage.to):
                out += [replace(stage, mode="count"), numbers]
                i += 2
                continue
        if isinstance(stage, Sort) and isinstance(follower, Group) and follower.by_order:
            out.append(replace(follower, order=stage.spec))
            i += 2
            continue
        out.append(stage)
        i += 1
    return out


def run_stages(df: DataFrame, stages: list[Any], context: Context) -> DataFrame:
    return reduce(lambda d, s: s.apply(d, context), optimized([parsed(s) for s in stages]), df)


def _path(text: str) -> str:
    return text.removeprefix("$")


def parsed(stage: Any) -> Stage:
    """A stage from its document, such as {"$match": {...}}."""
    if isinstance(stage, Stage):
        return stage
    (name, spec), = stage.items()
    if name == "$match":
        return Match(spec)
    if name == "$unwind":
        return Unwind(_path(spec)) if isinstance(spec, str) else Unwind(_path(spec["path"]), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex"))
    if name == "$lookup":
        return Lookup(spec.get("localField"), spec.get("foreignField"), spec["as"], spec.get("from"), None, spec.get("let", {}), tuple(map(parsed, spec.get("pipeline", ()))))
    simple = {"$project": Project, "$addFields": AddFields, "$set": AddFields, "$group": Group, "$sort": Sort, "$limit": Limit, "$skip": Skip, "$count": Count}
    if name not in simple:
        raise ValueError(f"unknown stage {name}")
    return simple[name](spec)


class StageBuilder:
    """Stages over one collection."""

    def match(self, spec: Any) -> Stage:
        return Match(spec)

    def unwind(self, path: str) -> Stage:
        return Unwind(_path(path))

    def lookup(self, local: str, foreign: str, to: str | None = None, *, pipeline: Callable | list | None = None, let: Mapping | None = None) -> Stage:
        return Lookup(local, foreign, to or local, None, None, let or {}, self._sub(pipeline))

    def external_lookup(self, source: str, local: str | None, foreign: str | None, to: str | None = None, *, pipeline: Callable | list | None = None, let: Mapping | None = None) -> Stage:
        return Lookup(local, foreign, to or local or source, source, None, let or {}, self._sub(pipeline))

    def _sub(self, pipeline: Callable | list | None) -> tuple[Stage, ...]:
        return tuple(map(parsed, pipeline(self) if callable(pipeline) else pipeline or ()))

    def project(self, spec: Mapping) -> Stage:
        return Project(spec)

    def add_fields(self, spec: Mapping) -> Stage:
        return AddFields(spec)

    def group(self, spec: Mapping) -> Stage:
        return Group(spec)

    def sort(self, spec: Mapping) -> Stage:
        return Sort(spec)

    def limit(self, n: int) -> Stage:
        return Limit(n)

    def skip(self, n: int) -> Stage:
        return Skip(n)

    def count(self, to: str = "count") -> Stage:
        return Count(to)


class TypedStageBuilder(StageBuilder):
    """Stages over a store of several document types."""

    def match(self, key: str, spec: Mapping | None = None) -> Stage:
        return Match({TYPE: key, **(spec or {})})

    def unwind(self, key: str, path: str) -> Stage:
        return Unwind(_path(path))

    def lookup(self, key: str, local: str, foreign: str, to: str | None = None, *, pipeline: Callable | list | None = None, let: Mapping | None = None) -> Stage:
        return Lookup(local, foreign, to or local, None, key, let or {}, self._sub(pipeline))

    def any_lookup(self, local: str, foreign: str, to: str | None = None, *, pipeline: Callable | list | None = None, let: Mapping | None = None) -> Stage:
        return Lookup(local, foreign, to or local, None, None, let or {}, self._sub(pipeline))
