"""What migrations are about: schemas of a whole database, its state, operations, and chains of migrations."""

from __future__ import annotations

import re
import secrets
import time
from collections import deque
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from docloom.schema import Node, Object, difference

RowChange = Callable[[dict[str, Any]], dict[str, Any]]
FrameChange = Callable[[DataFrame], DataFrame]


class MigrationError(RuntimeError):
    pass


@dataclass(frozen=True)
class Model:
    """A named, versioned set of document types that several stores may be instances of."""

    name: str
    version: str
    types: Mapping[str, Object]

    def expose(self) -> dict[str, Object]:
        return dict(self.types)

    def summary(self) -> dict[str, Any]:
        return {"name": self.name, "version": self.version, "types": sorted(self.types), "field_count": sum(len(t.fields) for t in self.types.values())}


@dataclass(frozen=True)
class Schemas:
    """The declared shape of a database."""

    collections: Mapping[str, Object] = field(default_factory=dict)
    multi: Mapping[str, Mapping[str, Object]] = field(default_factory=dict)
    models: Mapping[str, Mapping[str, Object]] = field(default_factory=dict)


@dataclass(frozen=True)
class State:
    """The contents of a database: each name's rows, and of instances the name of their model. Typed stores have `_type`."""

    collections: Mapping[str, DataFrame] = field(default_factory=dict)
    multi: Mapping[str, DataFrame] = field(default_factory=dict)
    instances: Mapping[str, DataFrame] = field(default_factory=dict)
    model_of: Mapping[str, str] = field(default_factory=dict)
    created_at: Mapping[str, str] = field(default_factory=dict)  # instance -> id of the migration that made it

    def put(self, part: str, name: str, value: Any) -> State:
        return replace(self, **{part: {**getattr(self, part), name: value}})

    def drop(self, part: str, name: str) -> State:
        return replace(self, **{part: {k: v for k, v in getattr(self, part).items() if k != name}})


@dataclass(frozen=True)
class Operation:
    """kind is one of the names in `engine.OPERATIONS`; target a table or model, type_name one of its types."""

    kind: str
    target: str
    type_name: str | None = None
    model: str | None = None
    new_type: str | None = None
    docs: tuple[Mapping[str, Any], ...] = ()
    up: FrameChange | None = None
    down: FrameChange | None = None
    irreversible: bool = False
    lossy: bool = False


@dataclass(frozen=True)
class Migration:
    id: str
    name: str
    parent: Migration | None
    schemas: Schemas
    migrate: Callable[[Any], Any]

    def __post_init__(self) -> None:
        if not self.id or not self.name:
            raise MigrationError("a migration needs an id and a name")
        if not callable(self.migrate):
            raise MigrationError(f"{self.id}: migrate has to be a function")
        if self.parent is not None and self.parent.id == self.id:
            raise MigrationError(f"{self.id} is its own parent")


def migration_id(name: str, now: float | None = None) -> str:
    """Minute, chance and name: YYYY_MM_DD_HHMM_xxxxxxxxxx@name."""
    stamp = time.strftime("%Y_%m_%d_%H%M", time.gmtime(now))
    slug = re.sub(r"[^a-zA-Z0-9]+", "-", name).strip("-").lower()
    return f"{stamp}_{''.join(secrets.choice('0123456789abcdefghjkmnpqrstvwxyz') for _ in range(10))}@{slug}"


def timestamp_of(id: str) -> str:
    return id.partition("@")[0]


def is_after(a: str, b: str) -> bool:
    """Whether migration a was made after b; ids without a time never are."""
    return all(x not in ("unknown", "current") for x in (a, b)) and timestamp_of(a) > timestamp_of(b)


def ancestors(m: Migration) -> list[Migration]:
    """From the parent to the root."""
    out = []
    while (m := m.parent) is not None:  # type: ignore[assignment]
        if any(x.id == m.id for x in out):
            raise MigrationError(f"the ancestors of {m.id} form a cycle")
        out.append(m)
    return out


def path_to(m: Migration) -> list[Migration]:
    return [*reversed(ancestors(m)), m]


def is_ancestor(a: Migration, b: Migration) -> bool:
    return any(x.id == a.id for x in ancestors(b))


def common_ancestor(a: Migration, b: Migration) -> Migration | None:
    own = {x.id for x in path_to(a)}
    return next((x for x in reversed(path_to(b)) if x.id in own), None)


def summary(m: Migration) -> dict[str, Any]:
    return {"id": m.id, "name": m.name, "parent": m.parent.id if m.parent else None, "depth": len(ancestors(m)), "collections": len(m.schemas.collections), "multi": len(m.schemas.multi), "models": len(m.schemas.models)}


def check_chain(migrations: list[Migration], roots: int = 1, allow_branches: bool = True) -> dict[str, Any]:
    """errors, warnings, order (parents first), roots, leaves and depth of a set of migrations."""
    errors, by_id = [], {m.id: m for m in migrations}
    for id in sorted({m.id for m in migrations if sum(x.id == m.id for x in migrations) > 1}):
        errors.append(f"duplicate id {id}")
    errors += [f"id {m.id} has characters that are not allowed" for m in migrations if not re.fullmatch(r"[a-zA-Z0-9_@-]+", m.id)]
    errors += [f"{m.id}: its parent {m.parent.id} is not among the migrations" for m in migrations if m.parent and m.parent.id not in by_id]
    for m in migrations:
        seen, x = {m.id}, m.parent
        while x is not None and x.id not in seen:
            seen.add(x.id)
            x = x.parent
        if x is not None:
            errors.append(f"{m.id}: its parents form a cycle")
    children: dict[str, list[Migration]] = {}
    for m in migrations:
        if m.parent:
            children.setdefault(m.parent.id, []).append(m)
    top, leaves = [m for m in migrations if m.parent is None], [m for m in migrations if m.id not in children]
    if migrations and len(top) != roots:
        errors.append(f"{len(top)} roots, where {roots} are allowed")
    branching = sorted(k for k, v in children.items() if len(v) > 1)
    if branching and not allow_branches:
        errors += [f"{k} has more than one child" for k in branching]
    order, waiting, depth = [], deque((m, 1) for m in top), 0
    while waiting and len(order) <= len(migrations):
        m, d = waiting.popleft()
        order.append(m)
        depth = max(depth, d)
        waiting.extend((c, d + 1) for c in children.get(m.id, []))
    return {"errors": errors, "warnings": [f"{k} has more than one child" for k in branching if allow_branches], "order": order, "roots": top, "leaves": leaves, "depth": depth}


def check_project(schemas: Schemas, last: Migration) -> list[str]:
    """Where the declared schemas differ from those of the last migration."""
    out = []
    for part in ("collections", "multi", "models"):
        now, then = getattr(schemas, part), getattr(last.schemas, part)
        out += [f"{part}: {n} is declared, but no migration has it" for n in sorted(now.keys() - then.keys())]
        out += [f"{part}: {n} is in the last migration, but not declared" for n in sorted(then.keys() - now.keys())]
        for n in sorted(now.keys() & then.keys()):
            pairs = {"": (then[n], now[n])} if isinstance(now[n], Node) else {k: (then[n].get(k), now[n].get(k)) for k in {*then[n], *now[n]}}
            for k, (a, b) in sorted(pairs.items()):
                if a is None or b is None:
                    out.append(f"{part}: {n}.{k} is only {'declared' if a is None else 'in the last migration'}")
                    continue
                out += [f"{part}: {n}{'.' + k if k else ''}: {what} {path}" for what, paths in difference(a, b).items() for path in paths]
    return out
