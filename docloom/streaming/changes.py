"""Change events of a store: one stream of its change log, dealt out to listeners by table."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.store import CHANGES_SCHEMA, Store

log = logging.getLogger(__name__)
OPERATIONS = ("insert", "update", "replace", "delete")
_watchers: list[Watcher] = []


def change_stream(store: Store) -> DataFrame:
    """The change log as a stream: seq, ns, operation, id, document (JSON)."""
    store.finish_changes()
    folder = f"{store.root}/_changes"
    store._fs(folder).mkdirs(store._path(folder))
    return store.spark.readStream.schema(CHANGES_SCHEMA).parquet(folder)


def change_log(store: Store) -> DataFrame:
    """The same as a table."""
    store.finish_changes()
    folder = f"{store.root}/_changes"
    store._fs(folder).mkdirs(store._path(folder))
    return store.spark.read.schema(CHANGES_SCHEMA).parquet(folder)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("ns", "operation").agg(F.count(F.lit(1)).alias("n"))


class Watcher:
    """Calls listeners with each change of their table and operation, in the order of commits; listeners of a table in the order they came."""

    def __init__(self, store: Store, checkpoint_dir: str):
        self.store, self.checkpoint_dir = store, checkpoint_dir
        self.listeners: dict[tuple[str, str], list[Callable[[dict[str, Any]], None]]] = {}
        self.query: Any = None
        _watchers.append(self)
        store.on_drop.append(self.dropped)

    def on(self, ns: str, operation: str, f: Callable[[dict[str, Any]], None]) -> None:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation}")
        self.listeners.setdefault((ns, operation), []).append(f)

    def off(self, ns: str, operation: str, f: Callable[[dict[str, Any]], None]) -> None:
        """Take a listener away; an unknown one is ignored. Without any left, the stream stops."""
        own = self.listeners.get((ns, operation), [])
        if f in own:
            own.remove(f)
        if not any(self.listeners.values()):
            self.stop()

    def _dispatch(self, batch: DataFrame, _: int) -> None:
        wanted = sorted({ns for (ns, _), fs in self.listeners.items() if fs})
        for row in batch.where(F.col("ns").isin(wanted)).orderBy("seq").toLocalIterator():
            event = {"seq": row.seq, "ns": row.ns, "operation": row.operation, "id": row.id, "document": json.loads(row.document)}
            for f in list(self.listeners.get((row.ns, row.operation), [])):
                try:
                    f(event)
                except Exception:
                    log.exception("a listener of %s failed", row.ns)

    def start(self, available_now: bool = False) -> Any:
        writer = change_stream(self.store).writeStream.foreachBatch(self._dispatch).option("checkpointLocation", self.checkpoint_dir)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def dropped(self, ns: str) -> None:
        """A table is gone: its listeners go, and without any left the stream stops."""
        for key in [k for k in self.listeners if k[0] == ns]:
            del self.listeners[key]
        if not any(self.listeners.values()):
            self.stop()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
        if self in _watchers:
            _watchers.remove(self)
        if self.dropped in self.store.on_drop:
            self.store.on_drop.remove(self.dropped)


def close_all_watchers() -> None:
    for w in list(_watchers):
        w.stop()
