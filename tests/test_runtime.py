import threading
import time

import pytest

from docloom.functions.paths import nested_value, safe_name
from docloom.operators.mutable import InvalidDocumentError, MutableCollection, apply_constraints
from docloom.runtime import OperationQueue, QueueTimeoutError, logger
from docloom.schema import number, obj, string
from docloom.sources.store import Store


def test_order_and_priorities():
    queue, gate, seen = OperationQueue(timeout=None), threading.Event(), []
    queue.add(gate.wait)
    futures = [queue.add(lambda n=n: seen.append(n), priority=p) for n, p in (("a", 0), ("b", 5), ("c", 0))]
    gate.set()
    assert queue.drain(5) and seen == ["b", "a", "c"] and all(f.done() for f in futures) and queue.stats()["done"] == 4


def test_failures_timeouts_and_retries():
    queue, calls = OperationQueue(timeout=None), []
    with pytest.raises(KeyError):
        queue.add(lambda: {}["x"]).result(5)
    with pytest.raises(QueueTimeoutError):
        queue.add(lambda: time.sleep(0.5), timeout=0.05).result(5)

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return "done"

    assert queue.add(flaky, retries=2).result(5) == "done"
    gate = threading.Event()
    queue.add(gate.wait)
    waiting = queue.add(lambda: None)
    assert queue.clear() == 1 and waiting.cancelled() and not queue.drain(0.05)
    gate.set()
    assert queue.drain(5) and queue.stats()["timed_out"] == 1


def test_logger(monkeypatch):
    monkeypatch.setenv("DOCLOOM_LOG", "store=debug")
    assert logger("store.commit").level == 10 and logger("other").level == 0


def test_plain_paths():
    assert nested_value({"a": [{"b": 1}]}, "a.0.b") == 1 and nested_value({"a": 1}, "a.b") is None
    assert safe_name("a.$[].b-c") == "a_b_c" and safe_name("0.x") == "p_0_x"


def test_constraints_on_demand(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    users = MutableCollection(store, "users", obj(name=string(), age=number()))
    users.insert_one({"name": "A", "age": -1})
    apply_constraints(store, "users", obj(name=string().indexed(unique=True), age=number()))
    assert store.about("users")["indexes"] == {"name_1": {"key": "name", "unique": True}}
    with pytest.raises(InvalidDocumentError):
        apply_constraints(store, "users", obj(name=string(), age=number(min_value=0)))
    with pytest.raises(KeyError):
        apply_constraints(store, "none", obj())
