"""Keyset pagination: pages after or before a document, with totals and positions.

The cursor is a predicate over the sort fields, so a page is a filter and a top-k, and counts are one
aggregation; no offset is scanned. Null sorts below every value, in the cursor as in the order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import value_at
from docloom.plans.stages import Context, Count, Group, Limit, Project, Skip, Sort, optimized, parsed, run_stages, unused

#: Rows that Python hooks see at most for one page; a page that ends there says so.
HOOK_SCAN = 10_000
NATURAL = "_natural"


@dataclass
class Page:
    """rows is a DataFrame in order, or a list after Python hooks. total and position are None where they were not asked for.

    cut_short: Python hooks have seen HOOK_SCAN rows, and there are more that might belong to the page.
    """

    rows: DataFrame | list
    total: int | None = None
    position: int | None = None
    has_more: bool | None = None
    cut_short: bool = False


def natural_id(column: Column) -> Column:
    """The part of an id after its type."""
    return F.substr(column, F.instr(column, ":") + 1)


def sort_keys(sort: Any, natural: bool = False) -> list[tuple[str, int]]:
    """(path, 1 or -1), with the id as last tie-breaker."""
    up = (1, "asc", "ascending")
    pairs = [(k, 1 if v in up else -1) for k, v in sort.items()] if isinstance(sort, dict) else [("_id", 1 if sort is None or sort in up else -1)]
    pairs = pairs if any(k == "_id" for k, _ in pairs) else [*pairs, ("_id", 1)]
    return [(NATURAL if natural and k == "_id" else k, v) for k, v in pairs] + ([("_id", 1)] if natural else [])


def _beyond(column: Column, value: Any, up: bool) -> Column:
    if value is None:
        return column.isNotNull() if up else F.lit(False)
    return column.isNotNull() & (column > F.lit(value)) if up else (column < F.lit(value)) | column.isNull()


def cursor(df: DataFrame, keys: list[tuple[str, int]], anchor: Row, forward: bool) -> Column:
    """The rows strictly after (or before) the anchor in the order of keys."""
    tests, same = [], None
    for i, (path, way) in enumerate(keys):
        column = value_at(df.schema, path)
        further, equal = _beyond(column, anchor[i], (way == 1) == forward), column.eqNullSafe(F.lit(anchor[i]))
        tests.append(further if same is None else same & further)
        same = equal if same is None else same & equal
    return reduce(lambda a, b: a | b, tests)


def order_by(df: DataFrame, keys: list[tuple[str, int]], forward: bool = True) -> list[Column]:
    return [value_at(df.schema, k).asc_nulls_first() if (way == 1) == forward else value_at(df.schema, k).desc_nulls_last() for k, way in keys]


def paginate(
    df: DataFrame,
    context: Context,
    where: Column | None = None,
    *,
    limit: int = 100,
    sort: Any = None,
    after_id: Any = None,
    before_id: Any = None,
    pipeline: list | None = None,
    sort_first: bool = True,
    natural_id_sort: bool = False,
    valid: Callable[[T.StructType], Column] | None = None,
    prepare: Callable | None = None,
    keep: Callable | Column | None = None,
    show: Callable | None = None,
    peek: bool = False,
    skip_total: bool = False,
) -> Page:
    """One page of df.

    sort_first: whether rows are sorted before the pipeline (one collection) or after it (several types). The order of
    rows sorted before it holds to its end, and for its limits, whatever joins lie between, unless it sorts or groups them itself.
    valid makes a test from the schema of the rows that the pipeline leaves; rows that fail it are left out of the page.
    prepare, keep and show take and give DataFrames or Columns if they are marked `column_hook`, and else single
    rows as dicts; such hooks see HOOK_SCAN rows at most. An anchor that isn't found sets no cursor.
    """
    if natural_id_sort:
        df = df.withColumn(NATURAL, natural_id(F.col("_id")))
    base = df.where(where) if where is not None else df
    keys = sort_keys(sort, natural_id_sort)
    anchor_id, forward = (after_id, True) if after_id is not None else (before_id, False)
    forward = forward or before_id is None
    anchor = df.where(F.col("_id") == F.lit(anchor_id)).select(*(value_at(df.schema, k).alias(f"k{i}") for i, (k, _) in enumerate(keys))).first() if anchor_id is not None else None
    beyond = cursor(base, keys, anchor, forward) if anchor is not None else None
    stages = pipeline or []

    total = position = None
    if not skip_total:
        (mark,) = unused(base, stages, "_beyond")
        counted = base.withColumn(mark, beyond if beyond is not None else F.lit(True))
        counted = run_stages(counted, stages, context) if stages else counted
        if mark in counted.columns:
            total, further = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(mark).cast("long")), F.lit(0))).first()
        else:  # a stage has left other rows than the documents
            total = counted.count()
            further = run_stages(base.where(beyond), stages, context).count() if beyond is not None else total

    rows = base.where(beyond) if beyond is not None else base
    hidden = unused(rows, stages, *(f"_key{i}" for i in range(len(keys))))
    if sort_first and stages:
        rows = rows.withColumns({h: value_at(rows.schema, k) for h, (k, _) in zip(hidden, keys, strict=True)})
        ways = [(h, way) for h, (_, way) in zip(hidden, keys, strict=True)]
        rows, order = _in_order(rows, stages, context, ways, forward)
    else:
        rows = run_stages(rows, stages, context) if stages else rows
        ways = keys
        order = order_by(rows, keys, forward)
    rows = rows.where(valid(rows.schema)) if valid is not None else rows
    ordered = rows.orderBy(*order) if order else rows
    python, cut_short = _python(prepare, keep, show), False
    if not python:
        if prepare is not None:
            ordered = prepare(ordered)
        if keep is not None:
            ordered = ordered.where(keep if isinstance(keep, Column) else keep(ordered))
        page, has_more, size = ordered.limit(limit), None, None
        if peek:
            has_more = ordered.limit(limit + 1).count() > limit
        if not forward:
            size = page.count() if not skip_total else None
            page = page.orderBy(*order_by(page, ways)) if all(k.split(".")[0] in page.columns for k, _ in ways) else page
        page = page.drop(NATURAL, *hidden)
        out: DataFrame | list = show(page) if show is not None else page
    else:
        out, has_more, cut_short = _by_rows(ordered.drop(NATURAL, *hidden), limit, prepare, keep, show, peek)
        if not forward:
            out.reverse()
        size = len(out)
    if total is not None:
        if anchor_id is None:
            position = 0
        elif anchor is None and forward:
            position = 1
        elif forward:
            position = total - further
        else:
            position = max(0, further - (size if size is not None else limit))
    return Page(out, total, position, has_more, cut_short)


def column_hook(f: Callable) -> Callable:
    """Marks a hook that works on DataFrames or Columns."""
    f.column_hook = True  # type: ignore[attr-defined]
    return f


def _python(*hooks: Any) -> bool:
    return any(h is not None and not isinstance(h, Column) and not getattr(h, "column_hook", False) for h in hooks)


def _in_order(rows: DataFrame, stages: list, context: Context, keys: list[tuple[str, int]], forward: bool) -> tuple[DataFrame, list[Column]]:
    """The rows after the stages, and the columns of the order they are in: the keys, hidden columns, are carried through; a sort of the pipeline's own comes before them."""
    order: list[Column] = order_by(rows, keys, forward)
    hidden = tuple(k for k, _ in keys)
    for stage in optimized([parsed(s) for s in stages]):
        if isinstance(stage, (Limit, Skip)) and order:
            rows = rows.orderBy(*order)
        if isinstance(stage, Sort):
            order = stage.order(rows.schema) + (order_by(rows, keys, forward) if set(hidden) <= set(rows.columns) else [])
        elif isinstance(stage, Project) and set(hidden) <= set(rows.columns):
            rows = stage.apply(rows, context, hidden)
        else:
            rows = stage.apply(rows, context)
        if isinstance(stage, (Group, Count)):
            order = []
    return rows, order


def _by_rows(rows: DataFrame, limit: int, prepare: Any, keep: Any, show: Any, peek: bool) -> tuple[list, bool | None, bool]:
    out, wanted, seen = [], limit + (1 if peek else 0), 0
    for row in rows.limit(HOOK_SCAN + 1).toLocalIterator():
        seen += 1
        if len(out) == wanted or seen > HOOK_SCAN:
            break
        doc = row.asDict(recursive=True)
        doc = prepare(doc) if prepare else doc
        if keep is None or keep(doc):
            out.append(show(doc) if show else doc)
    cut_short = seen > HOOK_SCAN and len(out) < wanted
    return out[:limit], (len(out) > limit or cut_short) if peek else None, cut_short
