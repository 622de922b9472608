"""Queries of what writes and of what keeps books: stores, migrations on tables and on stores, schemas, chains, change events.

Those that write make a store of their own in the shared checkpoint folder and read it back; operators that answer with plain
values are shown as rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.paths import nested_value, safe_name
from docloom.migrate import engine
from docloom.migrate.model import Migration, Model, Schemas, State, ancestors, check_chain, check_project, common_ancestor, is_after, path_to, summary, timestamp_of
from docloom.operators.collection import InvalidDocumentError, NotFoundError
from docloom.operators.constraints import DuplicateKeyError, index_plan, wanted
from docloom.operators.mutable import BulkWriteError, MutableCollection, MutableMulti, apply_constraints, new_instance, new_multi
from docloom.operators.updates import MISSING, REMOVE, partial, sanitize, split_set, undefined_to_null
from docloom.plans.stages import TYPE
from docloom.queries import PEOPLE, collection, people, query, read, shared_folder
from docloom.runtime import OperationQueue
from docloom.schema import array, difference, flat, indexes, integer, number, obj, optional, string, visit, walk
from docloom.sources.store import Store, WriteConflictError, with_retry
from docloom.streaming.changes import Watcher, change_counts, change_log


def fresh_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def told(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Plain values as a table."""
    return spark.createDataFrame(rows, schema)


def refused(error: type[BaseException], work) -> int:
    try:
        work()
    except error:
        return 1
    return 0


NATION = obj(_id=integer(), name=string().indexed(unique=True), region=integer(min_value=0))
CUSTOMER = obj(_id=integer(), name=string(), nation=integer(), balance=number(), segment=optional(string()))


def nations(spark: SparkSession, sf_dir: str) -> MutableCollection:
    out = MutableCollection(fresh_store(spark), "nation", NATION)
    out.insert_frame(read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS long) AS _id", "n_name AS name", "cast(n_regionkey AS long) AS region"))
    return out


def customers(spark: SparkSession, sf_dir: str) -> MutableCollection:
    out = MutableCollection(fresh_store(spark), "customer", CUSTOMER)
    out.insert_frame(read(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS long) AS _id", "c_name AS name", "cast(c_nationkey AS long) AS nation", "c_acctbal AS balance", "c_mktsegment AS segment"))
    return out


def people_store(spark: SparkSession, sf_dir: str) -> MutableMulti:
    given = people(spark, sf_dir)
    types = {"customer": obj(name=string(), nation=number(), balance=number(), segment=optional(string())), "supplier": obj(name=string(), nation=number(), balance=number())}
    out = MutableMulti(fresh_store(spark), "people", types)
    with out.store.unit_of_work():
        for key in types:
            out.store.append("people", given.df.where(F.col(TYPE) == key).drop(TYPE), key)
    return out


_NATION = "SELECT n_nationkey::BIGINT AS _id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"
_CUSTOMER = "(SELECT c_custkey::BIGINT AS _id, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"

# --- writes of one collection


@query(f"{_NATION} UNION ALL SELECT 900, 'ATLANTIS', 7")
def store_insert_one(spark, sf_dir):
    store = nations(spark, sf_dir)
    store.insert_one({"_id": 900, "name": "ATLANTIS", "region": 7})
    return store.df


@query("SELECT count(*)::BIGINT AS n, 1 AS same_id, 1 AS same_key, 1 AS same_twice, 1 AS invalid FROM nation")
def store_insert_duplicate(spark, sf_dir):
    """A taken id, a taken unique key, one id twice in a call, and a document that doesn't conform: all refused, and nothing is left of them."""
    store = nations(spark, sf_dir)
    found = (
        refused(DuplicateKeyError, lambda: store.insert_one({"_id": 3, "name": "X", "region": 1})),
        refused(DuplicateKeyError, lambda: store.insert_one({"_id": 901, "name": store.get_by_id(3).name, "region": 1})),
        refused(DuplicateKeyError, lambda: store.insert_many([{"_id": 902, "name": "X", "region": 1}, {"_id": 902, "name": "Y", "region": 1}])),
        refused(InvalidDocumentError, lambda: store.insert_many([{"_id": 903, "name": "Z", "region": 1}, {"_id": 904, "name": "W", "region": -1}])),
    )
    return told(spark, "n long, same_id int, same_key int, same_twice int, invalid int", [(store.count(), *found)])


@query(f"SELECT _id, name, nation, CASE WHEN segment = 'BUILDING' THEN balance + 10 ELSE balance END AS balance, CASE WHEN segment = 'BUILDING' THEN 'HOUSES' ELSE segment END AS segment FROM {_CUSTOMER}")
def store_update_many(spark, sf_dir):
    store = customers(spark, sf_dir)
    store.update_many({"segment": "BUILDING"}, {"$inc": {"balance": 10}, "$set": {"segment": "HOUSES"}})
    return store.df


@query("SELECT _id, CASE _id WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' ELSE name END AS name, CASE _id WHEN 2 THEN 9 WHEN 4 THEN 40 ELSE region END::BIGINT AS region FROM (SELECT n_nationkey::BIGINT AS _id, n_name AS name, n_regionkey::BIGINT AS region FROM nation) WHERE _id <> 5 UNION ALL SELECT 905, 'NEW', 3")
def store_update_replace_find(spark, sf_dir):
    """updateOne, replaceOne, findOneAndUpdate, findOneAndDelete and an upsert, one after another."""
    store = nations(spark, sf_dir)
    store.update_one({"_id": 1}, {"$set": {"name": "ONE"}})
    store.find_one_and_replace({"_id": 2}, {"name": "TWO", "region": 8})
    store.replace_one({"_id": 2}, {"name": "TWO", "region": 9})
    store.find_one_and_update({"_id": 4}, {"$set": {"region": 40}})
    store.find_one_and_delete({"_id": 5})
    store.update_one({"_id": 905}, {"$set": {"name": "NEW"}, "$setOnInsert": {"region": 3}}, upsert=True)
    return store.df


@query(f"SELECT * FROM {_CUSTOMER} WHERE NOT (balance < 0 AND segment = 'MACHINERY') AND _id <> (SELECT min(_id) FROM {_CUSTOMER} WHERE segment = 'AUTOMOBILE' AND NOT (balance < 0 AND segment = 'MACHINERY'))")
def store_delete(spark, sf_dir):
    store = customers(spark, sf_dir)
    store.delete_many({"balance": {"$lt": 0}, "segment": "MACHINERY"})
    store.delete_one({"segment": "AUTOMOBILE"})
    return store.df


@query(f"SELECT coalesce(_id, k) AS _id, coalesce(b, balance) AS balance FROM {_CUSTOMER} FULL JOIN (SELECT o_custkey::BIGINT AS k, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1) ON _id = k")
def store_bulk_upsert(spark, sf_dir):
    """Many changes for one id: the last order's price becomes the balance."""
    store = customers(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").selectExpr("cast(o_custkey AS long) AS _id", "o_totalprice AS balance", "o_orderkey AS at").withColumn("name", F.lit("?")).withColumn("nation", F.lit(0).cast("long"))
    store.merge_frame(orders, order="at")
    return store.df.select("_id", "balance")


@query("SELECT _id, CASE WHEN _id = 4 THEN 'FOUR' ELSE name END AS name, region FROM (" + _NATION + ") WHERE _id <> 3 UNION ALL SELECT 910, 'A', 1 UNION ALL SELECT 911, 'B', 1")
def store_bulk_ordered(spark, sf_dir):
    store = nations(spark, sf_dir)
    store.bulk_write([{"insert_one": {"_id": 910, "name": "A", "region": 1}}, {"delete_one": {"_id": 3}}, {"update_one": ({"_id": 4}, {"$set": {"name": "FOUR"}})}, {"insert_one": {"_id": 911, "name": "B", "region": 1}}])
    refused(DuplicateKeyError, lambda: store.bulk_write([{"delete_one": {"_id": 6}}, {"insert_one": {"_id": 910, "name": "C", "region": 1}}]))
    return store.df


@query("SELECT count(*)::BIGINT + 1 AS n, 1 AS failed, 1 AS place FROM nation")
def store_bulk_unordered(spark, sf_dir):
    store = nations(spark, sf_dir)
    errors: dict = {}
    try:
        store.bulk_write([{"insert_one": {"_id": 910, "name": "A", "region": 1}}, {"insert_one": {"_id": 910, "name": "B", "region": 1}}, {"update_one": ({"_id": 910}, {"$set": {"region": 2}})}], ordered=False)
    except BulkWriteError as e:
        errors = e.errors
    return told(spark, "n long, failed int, place int", [(store.count({"region": {"$gte": 0}}), len(errors), next(iter(errors)))])


@query("SELECT * FROM (VALUES ('nation', 0), ('nations', 1)) AS t(name, there)")
def store_rename_drop(spark, sf_dir):
    store = nations(spark, sf_dir)
    store.rename("nations")
    MutableCollection(store.store, "gone", NATION).drop()
    return told(spark, "name string, there int", [(n, int(n in store.store.tables())) for n in ("nation", "nations")])


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS estimated, 1 AS missing FROM nation")
def store_counts_and_get(spark, sf_dir):
    store = nations(spark, sf_dir)
    return told(spark, "n long, estimated long, missing int", [(store.count(), store.reader.estimated_count(), refused(NotFoundError, lambda: store.get_by_id(999)))])


@query("SELECT count(*)::BIGINT AS n, 1 AS commits, 0 AS left_over, 1 AS conflict FROM nation")
def store_unit_of_work(spark, sf_dir):
    """Two writes of one unit are one version; a unit that fails leaves nothing; one that comes second is a conflict."""
    store = nations(spark, sf_dir)
    version = store.store.version()
    with store.store.unit_of_work():
        store.insert_one({"_id": 920, "name": "A", "region": 1})
        store.delete_one({"_id": 920})
    commits = store.store.version() - version

    def fails() -> None:
        with store.store.unit_of_work():
            store.insert_one({"_id": 921, "name": "A", "region": 1})
            raise RuntimeError

    def second() -> None:
        with store.store.unit_of_work():
            store.delete_one({"_id": 1})
            Store(spark, store.store.root).create("other", store.df.schema)

    refused(RuntimeError, fails)
    return told(spark, "n long, commits int, left_over int, conflict int", [(store.count(), commits, store.count({"_id": 921}), refused(WriteConflictError, second))])


@query("SELECT 3 AS calls, 'done' AS result, 2 AS pauses, 1 AS other")
def retry_on_conflict(spark, sf_dir):
    calls, pauses = [], []

    def work() -> str:
        calls.append(1)
        if len(calls) < 3:
            raise WriteConflictError
        return "done"

    return told(spark, "calls int, result string, pauses int, other int", [(*reversed((with_retry(work, sleep=pauses.append), len(calls))), len(pauses), refused(KeyError, lambda: with_retry(lambda: {}["x"])))])


@query("SELECT n_nationkey::BIGINT AS _id, n_name AS name, CASE WHEN n_nationkey < 3 THEN 50 ELSE n_regionkey END::BIGINT AS region FROM nation UNION ALL SELECT i, 'N' || i, 1 FROM range(930, 934) AS t(i)")
def store_compacted(spark, sf_dir):
    """Many small inserts joined into one folder, old versions deleted: the same rows."""
    store = nations(spark, sf_dir)
    for i in range(930, 934):
        store.insert_one({"_id": i, "name": f"N{i}", "region": 1})
    store.update_many({"_id": {"$lt": 3}}, {"$set": {"region": 50}})
    store.store.compact("nation")
    store.store.expire(keep=1)
    return store.df


# --- writes of several types


@query(f"WITH {PEOPLE} SELECT _id, CASE WHEN _id = 'supplier:00000002' THEN 'RENAMED' ELSE name END AS name, CASE _id WHEN 'customer:00000001' THEN 5 WHEN 'customer:00000002' THEN 6 ELSE balance END AS balance, CASE WHEN _id = 'customer:00000001' THEN NULL ELSE segment END AS segment FROM people")
def multi_update(spark, sf_dir):
    store = people_store(spark, sf_dir)
    store.update_many({"customer": {"customer:00000001": {"balance": 5, "segment": REMOVE}, "customer:00000002": {"balance": 6}}, "supplier": {"supplier:00000002": {"name": "RENAMED"}, "supplier:none": {"name": "?"}}})
    return store.df.select("_id", "name", "balance", "segment")


@query(f"WITH {PEOPLE} SELECT _id, _type FROM people WHERE NOT (_type = 'supplier' AND balance < 0) AND nation <> 3 AND _id NOT IN ('customer:00000001', 'customer:00000002') UNION ALL SELECT 'supplier:new', 'supplier'")
def multi_delete_insert(spark, sf_dir):
    """deleteMany of a type, deleteIds, deleteAny, and an insert of one type."""
    store = people_store(spark, sf_dir)
    store.delete_many("supplier", {"balance": {"$lt": 0}})
    store.delete_ids("customer", [f"customer:0000000{i}" for i in (1, 2)])
    store.delete_any({"nation": 3})
    store.insert_one("supplier", {"_id": "supplier:new", "name": "S", "nation": 1, "balance": 0})
    return store.df.select("_id", TYPE)


@query("SELECT 1 AS found, 1 AS unknown_type, 1 AS missing, 1 AS wrong_id, 1 AS all_rows, 1 AS same_id")
def multi_find_one_and_refusals(spark, sf_dir):
    store = people_store(spark, sf_dir)
    row = store.reader.get_by_id("customer", "customer:00000001")
    same = store.reader.find_one_any({"_id": "customer:00000001"})
    found = (
        int(row["_id"] == same["_id"] == store.reader.find_one("customer", {"_id": "customer:00000001"})["_id"]),
        refused(KeyError, lambda: store.insert_one("nobody", {})),
        refused(NotFoundError, lambda: store.update_one("customer", "customer:none", {"balance": 1})),
        refused(ValueError, lambda: store.delete_id("customer", "supplier:00000001")),
        refused(ValueError, lambda: store.delete_any({})),
        refused(DuplicateKeyError, lambda: store.insert_one("customer", {"_id": "customer:00000001", "name": "x", "nation": 1, "balance": 1})),
    )
    return told(spark, "found int, unknown_type int, missing int, wrong_id int, all_rows int, same_id int", [found])


@query("SELECT 1 AS made, 1 AS twice, 1 AS in_unit, 'people' AS model")
def multi_new_store(spark, sf_dir):
    """A store that must not exist yet, and a tracked instance of a model."""
    store, types = fresh_store(spark), {"a": obj(n=integer())}
    made = new_multi(store, "first", types)
    made.insert_one("a", {"n": 1})

    def inside() -> None:
        with store.unit_of_work():
            new_multi(store, "third", types)

    new_instance(store, "second", "people", types)
    return told(spark, "made int, twice int, in_unit int, model string", [(made.df.count(), refused(FileExistsError, lambda: new_multi(store, "first", types)), refused(RuntimeError, inside), store.about("second")["model"])])


# --- change events


@query("SELECT * FROM (VALUES ('nation', 'insert', (SELECT count(*) FROM nation) + 1), ('nation', 'update', 2), ('nation', 'delete', 1)) AS t(ns, operation, n)")
def change_log_counts(spark, sf_dir):
    store = nations(spark, sf_dir)
    store.insert_one({"_id": 940, "name": "A", "region": 1})
    store.update_many({"_id": {"$in": [1, 2]}}, {"$set": {"region": 30}})
    store.delete_one({"_id": 940})
    return change_counts(change_log(store.store))


@query("SELECT * FROM (VALUES ('first', 'insert', 940), ('second', 'insert', 940), ('first', 'insert', 941), ('second', 'insert', 941), ('first', 'delete', 940)) AS t(listener, operation, id)")
def watch_fan_out(spark, sf_dir):
    """Two listeners of inserts and one of deletes; one that fails and one that was taken away don't disturb them."""
    store = MutableCollection(fresh_store(spark), "nation", NATION)
    for i in (940, 941):
        store.insert_one({"_id": i, "name": f"N{i}", "region": 1})
    store.delete_one({"_id": 940})
    seen: list[tuple[str, str, int]] = []
    watcher = Watcher(store.store, f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}")

    def listener(name: str):
        return lambda e: seen.append((name, e["operation"], int(e["id"])))

    def fails(event: dict) -> None:
        raise RuntimeError

    gone = listener("gone")
    for f in (listener("first"), fails, gone, listener("second")):
        watcher.on("nation", "insert", f)
    watcher.on("nation", "delete", listener("first"))
    watcher.off("nation", "insert", gone)
    watcher.start(available_now=True).awaitTermination()
    watcher.dropped("nation")
    return told(spark, "listener string, operation string, id int", seen)


# --- constraints and schemas


_INDEXED = obj(email=optional(string().indexed(unique=True, insensitive=True)), at=string().indexed(expire_after=60), inner=obj(k=integer().indexed(unique=True)))


@query("SELECT * FROM (VALUES ('at', false, false, 60), ('email', true, true, NULL), ('inner.k', true, false, NULL)) AS t(path, is_unique, insensitive, expire_after)")
def index_extraction(spark, sf_dir):
    return told(spark, "path string, is_unique boolean, insensitive boolean, expire_after int", [(k, i.unique, i.insensitive, i.expire_after) for k, i in indexes(_INDEXED).items()])


@query("SELECT * FROM (VALUES ('create', 'email_1'), ('recreate', 'at_1'), ('drop', 'old_1'), ('keep', 'inner.k_1')) AS t(todo, name)")
def index_plan_steps(spark, sf_dir):
    target = wanted(_INDEXED)
    plan = index_plan({"at_1": {"key": "at"}, "old_1": {"key": "old"}, "inner.k_1": target["inner.k_1"]}, target)
    return told(spark, "todo string, name string", [(k, n) for k, names in plan.items() for n in names])


@query("SELECT * FROM (VALUES ('_type_1', '_type', NULL), ('a_s', 's', 'a'), ('b_s', 's', 'b')) AS t(name, path, of_type)")
def index_names_by_type(spark, sf_dir):
    found = wanted({k: obj(s=string().indexed(unique=True)) for k in ("a", "b")})
    return told(spark, "name string, path string, of_type string", [(n, i["key"], i.get("where", {}).get(TYPE, {}).get("$eq")) for n, i in found.items()])


@query("SELECT count(*)::BIGINT AS n, 1 AS validator, 1 AS indexed, 1 AS missing, 1 AS broken FROM nation")
def constraints_on_demand(spark, sf_dir):
    """A table's rows and keys tested against a schema, which is noted with it; a missing table and rows that don't conform are errors."""
    store = nations(spark, sf_dir)
    apply_constraints(store.store, "nation", NATION)
    about = store.store.about("nation")
    return told(spark, "n long, validator int, indexed int, missing int, broken int", [(store.count(), int("properties" in json.dumps(about["validator"])), int("name_1" in about["indexes"]), refused(KeyError, lambda: apply_constraints(store.store, "none", NATION)), refused(InvalidDocumentError, lambda: apply_constraints(store.store, "nation", obj(region=integer(min_value=2)))))])


@query("SELECT n_nationkey::BIGINT AS _id FROM nation WHERE n_regionkey >= 2")
def filter_json_schema(spark, sf_dir):
    df = read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS long) AS _id", "n_name AS name", "cast(n_regionkey AS long) AS region")
    from docloom.operators.collection import Collection

    return Collection(df).find({"$jsonSchema": obj(region=integer(min_value=2))}, project={"_id": 1})


@query("SELECT k FROM (SELECT l_orderkey AS k, list(l_returnflag) AS fs FROM lineitem GROUP BY 1) WHERE list_contains(fs, 'A') AND list_contains(fs, 'R')")
def filter_all(spark, sf_dir):
    from docloom.operators.collection import Collection

    df = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("fs"))
    return Collection(df).find({"fs": {"$all": ["A", "R"]}}).select("k")


@query("SELECT o_orderkey FROM orders")
def filter_type(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_orderstatus": {"$type": "string"}}).select("o_orderkey")


@query("SELECT l_orderkey AS k, count(*)::INTEGER AS n FROM lineitem GROUP BY 1")
def expr_size(spark, sf_dir):
    from docloom.operators.collection import Collection

    df = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_quantity").alias("qs"))
    return Collection(df).aggregate([{"$project": {"k": 1, "n": {"$size": "$qs"}}}])


@query("SELECT * FROM (VALUES ('added', 'properties.x.max_length'), ('added', 'properties.z.type'), ('removed', 'properties.y.type'), ('changed', 'required[1]')) AS t(what, path)")
def schema_difference(spark, sf_dir):
    from docloom.schema import boolean

    found = difference(obj(x=string(), y=number()), obj(x=string(max_length=3), z=boolean()))
    return told(spark, "what string, path string", [(k, p) for k, paths in found.items() for p in paths])


@query("SELECT * FROM (VALUES ('properties.a.type', '\"string\"'), ('properties.b.items.type', '\"number\"'), ('properties.b.type', '\"array\"'), ('required[0]', '\"a\"'), ('required[1]', '\"b\"'), ('type', '\"object\"')) AS t(path, leaf)")
def schema_flat_types(spark, sf_dir):
    return told(spark, "path string, leaf string", sorted(flat(obj(a=string(), b=array(number()))).items()))


@query("SELECT * FROM (VALUES ('', 'Object'), ('a', 'Scalar'), ('b', 'Array'), ('b.$[]', 'Object'), ('b.$[].c', 'Scalar')) AS t(path, kind)")
def schema_walk(spark, sf_dir):
    return told(spark, "path string, kind string", [(p, type(n).__name__) for p, n in walk(obj(a=string(), b=array(obj(c=number()))))])


@query("SELECT * FROM (VALUES ('', 0), ('a', 1), ('a.$pipe[0]', 2), ('m', 1), ('m.$key', 2), ('m.$value', 2), ('u', 1), ('u.$union[0]', 2), ('u.$union[1]', 2)) AS t(path, depth)")
def schema_visit(spark, sf_dir):
    from docloom.schema import record, union

    seen: list[tuple[str, int]] = []
    visit(obj(a=string(min_length=2), m=record(number(), "^k"), u=union(string(), number())), lambda node, place: seen.append((".".join(place.path), place.depth)))
    return told(spark, "path string, depth int", seen)


@query("SELECT '{\"a\": 1, \"c\": {\"e\": [1]}}' AS removed, '{\"a\": null, \"b\": [null]}' AS nulled, '{\"$set\": {\"b.c\": 1}, \"$unset\": {\"a\": \"\", \"b.d\": \"\"}}' AS split, 'x' AS nested, 'p_1_a_b' AS safe")
def document_helpers(spark, sf_dir):
    row = (
        json.dumps(sanitize({"a": 1, "b": MISSING, "c": {"d": MISSING, "e": [1, MISSING]}})),
        json.dumps(undefined_to_null({"a": MISSING, "b": [MISSING]})),
        json.dumps(split_set({"a": REMOVE, "b": partial(c=1, d=REMOVE)})),
        nested_value({"a": [{"b": "x"}]}, "a.0.b"),
        safe_name("1.a[b]"),
    )
    return told(spark, "removed string, nulled string, split string, nested string, safe string", [row])


@query("SELECT * FROM (VALUES (0, 'high'), (1, 'low'), (2, 'low too')) AS t(place, name)")
def operation_queue_order(spark, sf_dir):
    import threading

    queue, order, gate = OperationQueue(), [], threading.Event()
    queue.add(gate.wait)
    for name, priority in (("low", 0), ("high", 5), ("low too", 0)):
        queue.add(lambda n=name: order.append(n), priority)
    gate.set()
    queue.drain(30)
    return told(spark, "place int, name string", list(enumerate(order)))


# --- migrations

_BASE = Schemas(collections={"customer": obj(c_custkey=integer(), c_name=string(), c_acctbal=number(), c_mktsegment=string())})
_SPLIT = Schemas(collections={"customer": obj(c_custkey=integer(), name=obj(kind=string(), number=string()), account=obj(c_acctbal=number(), c_mktsegment=string()))})


def _line() -> tuple[Migration, Migration]:
    root = Migration("2024_01_01_0000_aaaaaaaaaa@root", "root", None, _BASE, lambda b: None)

    def up(df: DataFrame) -> DataFrame:
        parts = F.split("c_name", "#")
        return df.select("_id", "c_custkey", F.struct(parts[0].alias("kind"), parts[1].alias("number")).alias("name"), F.struct("c_acctbal", "c_mktsegment").alias("account"))

    def down(df: DataFrame) -> DataFrame:
        return df.select("_id", "c_custkey", F.concat("name.kind", F.lit("#"), "name.number").alias("c_name"), "account.c_acctbal", "account.c_mktsegment")

    return root, Migration("2024_01_02_0000_bbbbbbbbbb@split", "split", root, _SPLIT, lambda b: b.collection("customer").transform(up, down))


def _customers(spark: SparkSession, sf_dir: str) -> State:
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")
    return State(collections={"customer": df})


@query("SELECT c_custkey::BIGINT AS c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, c_acctbal FROM customer")
def migrate_transform_apply(spark, sf_dir):
    after = engine.apply(spark, _customers(spark, sf_dir), _line()[1])
    return after.collections["customer"].select("c_custkey", "name.kind", "name.number", "account.c_acctbal")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def migrate_transform_reverse(spark, sf_dir):
    split = _line()[1]
    return engine.reverse(spark, engine.apply(spark, _customers(spark, sf_dir), split), split).collections["customer"].drop("_id")


def _typed_state(spark: SparkSession, sf_dir: str) -> State:
    """People as a store of two types and, by parity of the nation, as two instances of a model."""
    df = people(spark, sf_dir).df
    even = F.col("nation") % 2 == 0
    return State(multi={"people": df}, instances={"even": df.where(even), "odd": df.where(~even)}, model_of={"even": "folk", "odd": "folk"}, created_at={"even": "2024_01_01_0000_aaaaaaaaaa@root", "odd": "2024_01_09_0000_zzzzzzzzzz@later"})


_PERSON = {"customer": obj(name=string(), nation=number(), balance=number(), segment=optional(string())), "supplier": obj(name=string(), nation=number(), balance=number())}
_FOLK = Schemas(multi={"people": _PERSON}, models={"folk": _PERSON})


def _one(change, schemas: Schemas = _FOLK) -> Migration:
    return Migration("2024_01_05_0000_cccccccccc@one", "one", None, schemas, change)


_UP = "CASE WHEN _type = 'supplier' THEN upper(name) ELSE name END"


@query(f"WITH {PEOPLE} SELECT _id, {_UP.replace('upper', 'lower')} AS name FROM people")
def migrate_multi_type_transform(spark, sf_dir):
    m = _one(lambda b: b.multi("people").type("supplier").transform(lambda d: d.withColumn("name", F.lower("name"))))
    return engine.apply(spark, _typed_state(spark, sf_dir), m).multi["people"].select("_id", "name")


@query(f"WITH {PEOPLE} SELECT _id, CASE WHEN _type = 'supplier' AND nation % 2 = 0 THEN lower(name) ELSE name END AS name FROM people")
def migrate_models_type_transform(spark, sf_dir):
    """Instances made after the migration are left alone."""
    m = _one(lambda b: b.instances("folk").type("supplier").transform(lambda d: d.withColumn("name", F.lower("name"))))
    after = engine.apply(spark, _typed_state(spark, sf_dir), m).instances
    return after["even"].unionByName(after["odd"]).select("_id", "name")


@query(f"WITH {PEOPLE} SELECT _id, CASE WHEN _type = 'customer' AND nation % 2 = 1 THEN balance * 2 ELSE balance END AS balance FROM people")
def migrate_instance_type_transform(spark, sf_dir):
    m = _one(lambda b: b.instance("odd").type("customer").transform(lambda d: d.withColumn("balance", F.col("balance") * 2)))
    after = engine.apply(spark, _typed_state(spark, sf_dir), m).instances
    return after["even"].unionByName(after["odd"]).select("_id", "balance")


@query(f"WITH {PEOPLE} SELECT _id, _type FROM people WHERE _type <> 'supplier'")
def migrate_delete_type(spark, sf_dir):
    m = _one(lambda b: b.multi("people").delete_type("supplier"))
    return engine.apply(spark, _typed_state(spark, sf_dir), m).multi["people"].select("_id", TYPE)


@query(f"WITH {PEOPLE} SELECT _id, _type FROM people WHERE nation % 2 = 0 AND _type <> 'customer'")
def migrate_delete_models_type(spark, sf_dir):
    m = _one(lambda b: b.instances("folk").delete_type("customer"))
    return engine.apply(spark, _typed_state(spark, sf_dir), m).instances["even"].select("_id", TYPE)


@query(f"WITH {PEOPLE} SELECT _id, CASE WHEN _type = 'supplier' THEN 'vendor' ELSE _type END AS _type FROM people")
def migrate_rename_type(spark, sf_dir):
    m = _one(lambda b: b.multi("people").rename_type("supplier", "vendor"))
    return engine.apply(spark, _typed_state(spark, sf_dir), m).multi["people"].select("_id", TYPE)


@query(f"WITH {PEOPLE} SELECT _id, _type FROM people WHERE nation % 2 = 0")
def migrate_rename_models_type_round(spark, sf_dir):
    """Renamed with the ids' prefix, and back."""
    m = _one(lambda b: b.instances("folk").rename_type("supplier", "vendor"))
    state = engine.apply(spark, _typed_state(spark, sf_dir), m)
    return engine.reverse(spark, state, m).instances["even"].select("_id", TYPE)


@query(f"WITH {PEOPLE} SELECT 'people' AS store, _id FROM people UNION ALL SELECT 'even', _id FROM people WHERE nation % 2 = 0 UNION ALL SELECT 'people', 'supplier:seed' UNION ALL SELECT 'even', 'supplier:model' UNION ALL SELECT 'fresh', 'customer:x' UNION ALL SELECT 'plain', 'p'")
def migrate_create_and_seed(spark, sf_dir):
    """create and seed of a collection, of a type, of an instance and of all instances of a model."""
    row = {"name": "N", "nation": 1, "balance": 2}
    schemas = Schemas({"plain": obj(n=integer())}, _FOLK.multi, _FOLK.models)

    def change(b) -> None:
        b.create_collection("plain").seed([{"_id": "p", "n": 1}])
        b.multi("people").type("supplier").seed([{"_id": "supplier:seed", **row}])
        b.instances("folk").type("supplier").seed([{"_id": "supplier:model", **row}])
        b.create_instance("fresh", "folk").type("customer").seed([{"_id": "customer:x", **row}])

    after = engine.apply(spark, _typed_state(spark, sf_dir), _one(change, schemas))
    parts = [("people", after.multi["people"]), ("even", after.instances["even"]), ("fresh", after.instances["fresh"]), ("plain", after.collections["plain"])]
    out = [df.select(F.lit(n).alias("store"), "_id") for n, df in parts]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query(f"WITH {PEOPLE} SELECT _id FROM people")
def migrate_seed_reverse(spark, sf_dir):
    m = _one(lambda b: b.multi("people").type("supplier").seed([{"_id": "supplier:seed", "name": "N", "nation": 1, "balance": 2}, {"name": "M", "nation": 1, "balance": 2}]))
    state = engine.apply(spark, _typed_state(spark, sf_dir), m)
    return engine.reverse(spark, state, m).multi["people"].select("_id")


@query("SELECT 'folk' AS model, 1 AS marked, 1 AS unmarked, 1 AS twice, 1 AS never")
def migrate_mark_and_irreversible(spark, sf_dir):
    from docloom.migrate.model import MigrationError

    state = _typed_state(spark, sf_dir)
    mark, gone = _one(lambda b: b.mark_instance("people", "folk")), _one(lambda b: b.multi("people").delete_type("supplier"))
    after = engine.apply(spark, state, mark)
    back = engine.reverse(spark, after, mark)
    row = (after.model_of["people"], int("people" in after.instances and "people" not in after.multi), int("people" in back.multi), refused(MigrationError, lambda: engine.apply(spark, after, mark)), refused(MigrationError, lambda: engine.reverse(spark, state, gone)))
    return told(spark, "model string, marked int, unmarked int, twice int, never int", [row])


def _store_line() -> tuple[Migration, Migration, Migration]:
    product, with_more = obj(name=string(), price=number()), obj(name=string(), price=number(), more=string())
    one = Schemas(collections={"products": product}, models={"posts": {"article": obj(title=string())}})
    two = Schemas(collections={"products": with_more}, models={"posts": {"story": obj(title=string())}})
    keyed = Schemas(collections={"products": obj(name=string().indexed(unique=True), price=number(), more=string())}, models=two.models)

    def first(b) -> None:
        b.create_collection("products").seed([{"_id": "p1", "name": "A", "price": 1}, {"_id": "p2", "name": "B", "price": 2}])
        b.create_instance("main", "posts").type("article").seed([{"_id": "article:1", "title": "hi"}])

    def second(b) -> None:
        b.collection("products").transform(lambda d: d.withColumn("more", F.lit("none")), lambda d: d.drop("more"))
        b.instances("posts").rename_type("article", "story")

    m1 = Migration("2024_01_01_0000_aaaaaaaaaa@one", "one", None, one, first)
    m2 = Migration("2024_01_02_0000_bbbbbbbbbb@two", "two", m1, two, second)
    m3 = Migration("2024_01_03_0000_cccccccccc@three", "three", m2, keyed, lambda b: (b.update_indexes("products"), b.instances("posts").type("story").transform(lambda d: d.withColumn("title", F.upper("title")), lambda d: d.withColumn("title", F.lower("title")))))
    return m1, m2, m3


def _migrated(spark: SparkSession) -> tuple[Store, tuple[Migration, Migration, Migration]]:
    store, line = fresh_store(spark), _store_line()
    for m in line:
        engine.migrate(store, m)
    return store, line


@query("SELECT * FROM (VALUES ('one', 'applied', NULL), ('one', 'applied', 'main'), ('two', 'applied', NULL), ('two', 'applied', 'main'), ('three', 'applied', NULL), ('three', 'applied', 'main'), ('three', 'reverted', NULL), ('three', 'reverted', 'main')) AS t(name, operation, target)")
def migrate_store_history(spark, sf_dir):
    store, line = _migrated(spark)
    engine.rollback(store, line[2])
    return engine.history(store).select("name", "operation", "target")


@query("SELECT * FROM (VALUES ('p1', 'A', 'none'), ('p2', 'B', 'none'), ('story:1', 'HI', NULL)) AS t(_id, name, more)")
def migrate_store_rows(spark, sf_dir):
    store, _ = _migrated(spark)
    return store.read("products").select("_id", "name", "more").unionAll(store.read("main").select("_id", F.col("title").alias("name"), F.lit(None).cast("string")))


@query("SELECT 1 AS indexed, 1 AS refused")
def migrate_update_indexes(spark, sf_dir):
    """The third migration's unique key is noted with the table, and refused where rows break it."""
    store, line = _migrated(spark)
    other = fresh_store(spark)
    for m in line[:2]:
        engine.migrate(other, m)
    other.write("products", other.read("products").withColumn("name", F.lit("same")))
    return told(spark, "indexed int, refused int", [(int(store.about("products")["indexes"].get("name_1", {}).get("unique") is True), refused(DuplicateKeyError, lambda: engine.migrate(other, line[2])))])


@query("SELECT * FROM (VALUES ('main', 0, false), ('second', 2, true), ('late', 0, true)) AS t(instance, missing, orphaned)")
def migrate_catch_up_detection(spark, sf_dir):
    """An instance made after the first migration misses two; one made after the last misses none."""
    store, line = _migrated(spark)
    for name, at in (("second", line[0].id), ("late", line[2].id)):
        with store.unit_of_work():
            store.write(name, spark.createDataFrame([("article:9", "article", "low")], f"_id string, {TYPE} string, title string"), typed=True)
            store.about(name, model="posts", created=at)
    found = engine.catch_up_needed(store, list(line))
    return told(spark, "instance string, missing int, orphaned boolean", [(n, len(r["missing"]), r["orphaned"]) for n, r in found.items()])


@query("SELECT * FROM (VALUES ('story:9', 'story', 'LOW'), ('story:1', 'story', 'HI')) AS t(_id, _type, title)")
def migrate_catch_up(spark, sf_dir):
    store, line = _migrated(spark)
    with store.unit_of_work():
        store.write("second", spark.createDataFrame([("article:9", "article", "low")], f"_id string, {TYPE} string, title string"), typed=True)
        store.about("second", model="posts", created=line[0].id)
    engine.catch_up(store, "second", list(line))
    return store.read("second").select("_id", TYPE, "title").unionByName(store.read("main").select("_id", TYPE, "title"))


@query("SELECT * FROM (VALUES ('one', 'applied', false), ('two', 'applied', false), ('three', 'reverted', true)) AS t(name, state, pending)")
def migrate_status(spark, sf_dir):
    store, line = _migrated(spark)
    engine.rollback(store, line[2])
    report = engine.status(store, list(line), line[2].schemas)
    return told(spark, "name string, state string, pending boolean", [(m.name, report["states"][m.id], m.id in report["pending"]) for m in line])


@query("SELECT * FROM (VALUES ('one', 0, 0), ('two', 0, 0), ('bad', 1, 0), ('lossy', 0, 1)) AS t(name, errors, warnings)")
def migrate_simulation(spark, sf_dir):
    """A chain that is sound, a transform that loses a field, and a rollback that doesn't restore the rows."""
    m1, m2, _ = _store_line()
    bad = Migration("2024_01_03_0000_dddddddddd@bad", "bad", m2, m2.schemas, lambda b: b.collection("products").transform(lambda d: d.drop("name"), lambda d: d))
    lossy = Migration("2024_01_03_0000_eeeeeeeeee@lossy", "lossy", m2, m2.schemas, lambda b: b.collection("products").transform(lambda d: d.withColumn("price", F.lit(1.0)), lambda d: d))
    found = [*zip(("one", "two"), engine.simulate_all(spark, [m1, m2]), strict=True), ("bad", engine.simulate(spark, bad)), ("lossy", engine.simulate(spark, lossy))]
    return told(spark, "name string, errors int, warnings int", [(n, len(r["errors"]), len(r["warnings"])) for n, r in found])


@query("SELECT * FROM (VALUES ('quick', 10), ('normal', 100), ('hard', 500)) AS t(power, n)")
def migrate_mock_rows(spark, sf_dir):
    schemas = Schemas(collections={"products": obj(name=string(), price=number())})
    return told(spark, "power string, n int", [(p, engine.mock_state(spark, schemas, n).collections["products"].count()) for p, n in engine.POWER.items()])


@query("SELECT * FROM (VALUES ('sound', 0), ('no parent', 2), ('twice', 1), ('branches', 1), ('two roots', 1), ('other schemas', 1), ('same schemas', 0)) AS t(chain, errors)")
def migration_chain_checks(spark, sf_dir):
    m1, m2, m3 = _store_line()
    other = Migration("2024_01_04_0000_ffffffffff@other", "other", m1, m2.schemas, m2.migrate)
    root = Migration("2024_01_04_0000_gggggggggg@root", "root", None, m1.schemas, m1.migrate)
    rows = [(n, len(check_chain(ms, allow_branches=False)["errors"])) for n, ms in (("sound", [m3, m1, m2]), ("no parent", [m2]), ("twice", [m1, m1, m2]), ("branches", [m1, m2, other]), ("two roots", [m1, root, m2]))]
    rows[2] = ("twice", sum("duplicate" in e for e in check_chain([m1, m1, m2])["errors"]))
    rows += [("other schemas", int(bool(check_project(m1.schemas, m2)))), ("same schemas", len(check_project(m2.schemas, m2)))]
    return told(spark, "chain string, errors int", rows)


@query("SELECT * FROM (VALUES ('one', 0, '', '2024_01_01_0000_aaaaaaaaaa'), ('two', 1, 'one', '2024_01_02_0000_bbbbbbbbbb'), ('three', 2, 'two,one', '2024_01_03_0000_cccccccccc')) AS t(name, depth, ancestors, stamp)")
def migration_ancestry(spark, sf_dir):
    line = _store_line()
    rows = [(m.name, summary(m)["depth"], ",".join(a.name for a in ancestors(m)), timestamp_of(m.id)) for m in line]
    if common_ancestor(line[1], line[2]) is not line[1] or path_to(line[2]) != list(line) or not is_after(line[1].id, line[0].id):
        raise AssertionError("the line of migrations is out of order")
    return told(spark, "name string, depth int, ancestors string, stamp string", rows)


@query("SELECT * FROM (VALUES ('before', true), ('on the line', true), ('older line', false), ('by time', false), ('unknown', true)) AS t(maker, concerned)")
def instance_eligibility(spark, sf_dir):
    """Whether the second migration concerns instances by who made them: by ancestry first, and by time where ancestry says nothing."""
    m1, m2, m3 = _store_line()
    side = Migration("2024_01_09_0000_hhhhhhhhhh@side", "side", m1, m1.schemas, m1.migrate)
    late_parent = Migration("2024_01_08_0000_iiiiiiiiii@late", "late", None, m1.schemas, m1.migrate)
    child = Migration("2024_01_02_0000_jjjjjjjjjj@child", "child", late_parent, m1.schemas, m1.migrate)
    every = [m1, m2, m3, side, late_parent, child]
    rows = [("before", engine.concerns(m2, m1.id, every)), ("on the line", engine.concerns(child, late_parent.id, every)), ("older line", engine.concerns(m2, m3.id, every)), ("by time", engine.concerns(m2, side.id, every)), ("unknown", engine.concerns(m2, "unknown", every))]
    return told(spark, "maker string, concerned boolean", rows)


@query("SELECT 4 AS operations, 1 AS creates, true AS irreversible, true AS lossy, 1 AS fields")
def migration_summary(spark, sf_dir):
    b = engine.Builder(_FOLK)
    b.create_collection("x")
    b.multi("people").delete_type("supplier")
    b.multi("people").rename_type("customer", "client")
    b.update_indexes("x")
    found = b.summary()
    return told(spark, "operations int, creates int, irreversible boolean, lossy boolean, fields int", [(found["operations"], found["by_kind"]["create_collection"], found["irreversible"], found["lossy"], Model("m", "1", {"a": obj(n=integer())}).summary()["field_count"])])


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def migrate_by_rows(spark, sf_dir):
    """A change of single documents, for what Columns can't express."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return engine.by_rows(lambda d: {**d, "c_name": d["c_name"].upper()}, df.schema)(df)
