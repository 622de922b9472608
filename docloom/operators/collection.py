"""Collections of one schema, and stores of several document types, read as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.filters import compile_filter
from docloom.functions.paths import value_at
from docloom.operators.paginate import Page, paginate
from docloom.plans.stages import TYPE, Context, StageBuilder, TypedStageBuilder, parsed, run_stages
from docloom.schema import Object

Filter = Mapping[str, Any] | Column | None


class NotFoundError(LookupError):
    pass


class InvalidDocumentError(ValueError):
    pass


def _options(df: DataFrame, sort: Mapping | None, skip: int, limit: int | None, project: Mapping | None) -> DataFrame:
    stages: list[Any] = [{"$sort": sort}] if sort else []
    stages += [{"$skip": skip}] if skip else []
    stages += [{"$limit": limit}] if limit is not None else []
    stages += [{"$project": project}] if project else []
    return run_stages(df, stages, Context(df))


class Reader:
    """What both kinds of tables share."""

    def __init__(self, df: DataFrame, tables: Mapping[str, DataFrame] | None = None, trusted: bool = False):
        self.df, self.tables, self.trusted = df, dict(tables or {}), trusted

    @property
    def context(self) -> Context:
        return Context(self.df, self.tables)

    def filter(self, spec: Filter) -> Column:
        return compile_filter(spec, self.df.schema)

    def _one(self, df: DataFrame, valid: Column) -> Row | None:
        row = df.withColumn("_valid", valid).limit(1).first()
        if row is None:
            return None
        if not row["_valid"]:
            raise InvalidDocumentError(str(row))
        return Row(**{k: v for k, v in row.asDict().items() if k != "_valid"})

    def distinct(self, path: str, spec: Filter = None) -> DataFrame:
        """value: the distinct values at a path; those of arrays one by one."""
        rows = self.df.where(self.filter(spec))
        value = value_at(self.df.schema, path)
        inside = isinstance(rows.select(value.alias("v")).schema["v"].dataType, T.ArrayType)
        return rows.select((F.explode(value) if inside else value).alias("value")).where("value is not null").distinct()


class Collection(Reader):
    """Documents of one schema. `trusted`: rows were validated when written, so reads don't test them."""

    def __init__(self, df: DataFrame, schema: Object | None = None, tables: Mapping[str, DataFrame] | None = None, trusted: bool = False):
        super().__init__(df, tables, trusted)
        self.schema = schema

    @property
    def valid(self) -> Column:
        return self.schema.valid(self.df.schema) if self.schema and not self.trusted else F.lit(True)

    def find(self, spec: Filter = None, *, sort: Mapping | None = None, skip: int = 0, limit: int | None = None, project: Mapping | None = None) -> DataFrame:
        """Matching documents that conform; the others are left out before skip and limit."""
        return _options(self.df.where(self.filter(spec)).where(self.valid), sort, skip, limit, project)

    def find_one(self, spec: Filter = None) -> Row | None:
        return self.df.where(self.filter(spec)).where(self.valid).limit(1).first()

    def get_by_id(self, id: Any) -> Row:
        row = self.find_one({"_id": id})
        if row is None:
            raise NotFoundError(f"no element found: {id}")
        return row

    def find_invalid(self, spec: Filter = None) -> DataFrame:
        return self.df.where(self.filter(spec)).where(~self.valid)

    def count_documents(self, spec: Filter = None) -> DataFrame:
        """count: of all matching documents, whether they conform or not."""
        return self.df.where(self.filter(spec)).agg(F.count(F.lit(1)).alias("count"))

    def estimated_count(self) -> int:
        """All rows; of a table read from Parquet as it is, by the files' footers alone."""
        return self.df.select(F.lit(1)).count()

    def aggregate(self, pipeline: list | Callable[[StageBuilder], list]) -> DataFrame:
        return run_stages(self.df, pipeline(StageBuilder()) if callable(pipeline) else pipeline, self.context)

    def paginate(self, spec: Filter = None, *, pipeline: list | Callable | None = None, valid_only: bool = False, **options: Any) -> Page:
        """See paginate(); rows are sorted before the pipeline. Counts take all stored rows unless valid_only is set."""
        stages = pipeline(StageBuilder()) if callable(pipeline) else pipeline
        where = self.filter(spec) & self.valid if valid_only else self.filter(spec)
        return paginate(self.df, self.context, where, pipeline=stages and list(map(parsed, stages)), sort_first=True, valid=self.schema.valid if self.schema and not self.trusted else None, **options)


class MultiCollection(Reader):
    """Documents of several types in one table, told apart by `_type` (and laid out by it, so that a type's filter prunes files)."""

    def __init__(self, df: DataFrame, types: Mapping[str, Object], tables: Mapping[str, DataFrame] | None = None, trusted: bool = False):
        super().__init__(df, tables, trusted)
        self.types = dict(types)

    @classmethod
    def union(cls, parts: Mapping[str, DataFrame], types: Mapping[str, Object] | None = None, tables: Mapping[str, DataFrame] | None = None, trusted: bool = False) -> MultiCollection:
        """One store of DataFrames by type."""
        typed = [df.withColumn(TYPE, F.lit(k)) for k, df in parts.items()]
        return cls(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed), types or {k: Object() for k in parts}, tables, trusted)

    def valid_of(self, key: str) -> Column:
        return F.lit(True) if self.trusted else self.types[key].valid(self.df.schema)

    @property
    def valid(self) -> Column:
        """Conforms to the schema of its own type; other types never do."""
        return F.lit(True) if self.trusted else self.valid_in(self.df.schema)

    def valid_in(self, schema: T.StructType) -> Column:
        """The same for rows of a schema of their own, such as those that a pipeline leaves."""
        if TYPE not in schema.names:
            return F.lit(False)
        return F.coalesce(reduce(lambda a, b: a | b, [(F.col(TYPE) == k) & node.valid(schema) for k, node in self.types.items()]), F.lit(False))

    def _known(self, key: str) -> Column:
        if key not in self.types:
            raise KeyError(f"unknown document type {key}")
        return F.col(TYPE) == key

    def find(self, key: str, spec: Filter = None, *, sort: Mapping | None = None, skip: int = 0, limit: int | None = None, project: Mapping | None = None) -> DataFrame:
        return _options(self.df.where(self._known(key)).where(self.filter(spec)).where(self.valid_of(key)), sort, skip, limit, project)

    def find_any(self, spec: Filter = None, *, sort: Mapping | None = None, skip: int = 0, limit: int | None = None, project: Mapping | None = None) -> DataFrame:
        return _options(self.df.where(self.filter(spec)).where(self.valid), sort, skip, limit, project)

    def find_one(self, key: str, spec: Filter = None) -> Row | None:
        return self._one(self.df.where(self._known(key)).where(self.filter(spec)), self.valid_of(key))

    def find_one_any(self, spec: Filter = None) -> Row | None:
        return self._one(self.df.where(self.filter(spec)), self.valid)

    def get_by_id(self, key: str, id: Any) -> Row:
        row = self.find_one(key, {"_id": id})
        if row is None:
            raise NotFoundError(f"no element found: {id}")
        return row

    def count_documents(self, key: str, spec: Filter = None) -> DataFrame:
        return self.df.where(self._known(key)).where(self.filter(spec)).agg(F.count(F.lit(1)).alias("count"))

    def aggregate(self, pipeline: list | Callable[[TypedStageBuilder], list]) -> DataFrame:
        return run_stages(self.df, pipeline(TypedStageBuilder()) if callable(pipeline) else pipeline, self.context)

    def paginate(self, keys: str | list[str], spec: Filter = None, *, pipeline: list | Callable | None = None, after_id: Any = None, before_id: Any = None, valid_only: bool = False, **options: Any) -> Page:
        """See paginate(); rows are sorted after the pipeline. An anchor's id has to begin with one of the types."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        for key in keys:
            self._known(key)
        anchor = after_id if after_id is not None else before_id
        if anchor is not None and not any(str(anchor).startswith(f"{k}:") for k in keys):
            raise ValueError(f"invalid id {anchor}: it has to begin with one of {', '.join(k + ':' for k in keys)}")
        stages = pipeline(TypedStageBuilder()) if callable(pipeline) else pipeline
        typed = F.col(TYPE) == keys[0] if len(keys) == 1 else F.col(TYPE).isin(keys)
        where = typed & self.filter(spec)
        where = where & self.valid if valid_only else where
        return paginate(self.df, self.context, where, pipeline=stages and list(map(parsed, stages)), sort_first=False, valid=None if self.trusted else self.valid_in, after_id=after_id, before_id=before_id, **options)
