"""Filters, expressions, stages, pagination, schemas, updates, the store, migrations and their command line."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.filters import compile_filter
from docloom.migrate import cli, engine
from docloom.migrate.model import Migration, MigrationError, Model, Schemas, check_chain, check_project, common_ancestor, is_after, is_ancestor, migration_id, summary
from docloom.operators.collection import Collection, InvalidDocumentError, MultiCollection, NotFoundError
from docloom.operators.constraints import DuplicateKeyError, index_plan, vacuum, wanted
from docloom.operators.mutable import MutableCollection, MutableMulti, new_id
from docloom.operators.paginate import column_hook
from docloom.operators.updates import MISSING, REMOVE, UndefinedValueError, partial, sanitize, split_set, undefined_to_null, updated
from docloom.plans.stages import Lookup, Match, StageBuilder, Unwind, optimized
from docloom.schema import Index, SchemaError, array, boolean, combined, date, difference, indexes, integer, intersect, literal, null, nullable, number, obj, optional, record, ref_id, same, string, union
from docloom.sources.store import Store, WriteConflictError, with_retry
from docloom.streaming.changes import Watcher, change_log

DOCS = "_id string, name string, age int, tags array<string>, address struct<city:string,zip:int>, items array<struct<k:string,v:int>>"
ROWS = [
    ("a", "Ann", 30, ["x", "y"], ("Rome", 1), [("p", 1), ("q", 5)]),
    ("b", "Bob", None, [], None, None),
    ("c", "Cid", 25, None, ("Oslo", None), [("p", 9)]),
    ("d", None, 40, ["y"], ("Rome", 2), []),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, "abcd"),
        ({"name": "Ann"}, "a"),
        ({"name": None}, "d"),
        ({"missing": None}, "abcd"),
        ({"tags": "y"}, "ad"),
        ({"tags": ["x", "y"]}, "a"),
        ({"tags": []}, "b"),
        ({"tags": {"$all": ["x", "y"]}}, "a"),
        ({"tags": {"$size": 1}}, "d"),
        ({"tags.0": "y"}, "d"),
        ({"address.city": "Rome", "age": {"$gte": 35}}, "d"),
        ({"age": {"$gt": 25, "$lt": 40}}, "a"),
        ({"age": {"$ne": 30}}, "bcd"),
        ({"age": {"$gt": "text"}}, ""),
        ({"age": {"$exists": False}}, "b"),
        ({"age": {"$in": [25, None]}}, "bc"),
        ({"age": {"$nin": [25, None]}}, "ad"),
        ({"age": {"$not": {"$gt": 26}}}, "bc"),
        ({"age": {"$mod": [10, 0]}}, "ad"),
        ({"name": {"$regex": "^b", "$options": "i"}}, "b"),
        ({"name": re.compile("^[AC]")}, "ac"),
        ({"items.k": "p"}, "ac"),
        ({"items": {"$elemMatch": {"k": "p", "v": {"$gt": 5}}}}, "c"),
        ({"tags": {"$elemMatch": {"$eq": "x"}}}, "a"),
        ({"$nor": [{"age": {"$gt": 26}}, {"name": "Bob"}]}, "c"),
        ({"$or": [{"name": "Ann"}, {"$and": [{"age": 40}, {"tags": "y"}]}]}, "ad"),
        ({"$expr": {"$gt": ["$age", {"$multiply": ["$address.zip", 25]}]}}, "ac"),
        ({"name": {"$type": "string"}}, "abc"),
    ],
)
def test_filters(people, spec, want):
    got = people.where(compile_filter(spec, people.schema))
    assert "".join(sorted(r._id for r in got.collect())) == want


def test_unknown_operators(people):
    for bad in ({"age": {"$near": 1}}, {"$where": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            compile_filter(bad, people.schema)


def test_presence(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, None, [])], "id int, a string, _present array<string>")
    assert [r.id for r in df.where(compile_filter({"a": {"$exists": True}}, df.schema)).collect()] == [1]


def test_stages_and_peephole(people, spark):
    teams = spark.createDataFrame([("t1", "Rome", 5), ("t2", "Rome", 7), ("t3", "Bonn", 1)], "_id string, city string, size int")
    store = Collection(people, tables={"teams": teams})
    full = store.aggregate(lambda s: [s.external_lookup("teams", "address.city", "city", "teams"), s.project({"n": {"$size": "$teams"}})])
    assert {r._id: r.n for r in full.collect()} == {"a": 2, "b": 0, "c": 0, "d": 2}
    flat = store.aggregate(lambda s: [s.external_lookup("teams", "address.city", "city", "team"), s.unwind("team"), s.add_fields({"size": "$team.size"}), s.sort({"size": -1, "_id": 1}), s.limit(1), s.project({"size": 1})])
    assert [tuple(r) for r in flat.collect()] == [("a", 7)]
    builder = StageBuilder()
    plan = optimized([builder.external_lookup("teams", "x", "y", "z"), builder.unwind("z")])
    assert len(plan) == 1 and plan[0].mode == "inner"
    plan = optimized([builder.external_lookup("teams", "x", "y", "z"), builder.match({"z": {"$size": 0}}), builder.project({"_id": 1})])
    assert plan[0].mode == "anti" and len(plan) == 2
    plan = optimized([Lookup("x", "y", "z"), Match({"z": {"$ne": []}}), Unwind("z")])
    assert plan[0].mode == "array"
    out = Collection(people).aggregate([{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}, {"$count": "n"}])
    assert out.first().n == 5
    kept = Collection(people).aggregate([{"$project": {"age": 0, "_id": 0}}])
    assert kept.columns == ["name", "tags", "address", "items"]


def test_correlated_lookup(people, spark):
    limits = spark.createDataFrame([("Rome", 35), ("Rome", 20), ("Oslo", 20)], "city string, age int")
    out = Collection(people, tables={"limits": limits}).aggregate(lambda s: [s.external_lookup("limits", "address.city", "city", "over", let={"own": "$age"}, pipeline=[{"$match": {"$expr": {"$lt": ["$age", "$$own"]}}}, {"$sort": {"age": -1}}, {"$limit": 1}]), s.project({"over": 1})])
    assert {r._id: [o.age for o in r.over] for r in out.collect()} == {"a": [20], "b": [], "c": [20], "d": [35]}


def test_expressions(people):
    out = Collection(people).aggregate([{"$match": {"_id": "a"}}, {"$project": {"_id": 0, "big": {"$cond": {"if": {"$gt": ["$age", 26]}, "then": "y", "else": "n"}}, "last": {"$arrayElemAt": ["$tags", -1]}, "over": {"$arrayElemAt": ["$tags", 9]}, "half": {"$divide": ["$age", 0]}, "up": {"$map": {"input": "$tags", "as": "t", "in": {"$toUpper": "$$t"}}}, "ks": "$items.k", "id": {"$toObjectId": "$_id"}, "fixed": {"$literal": "$x"}}}])
    assert out.first().asDict() == {"big": "y", "last": "y", "over": None, "half": None, "up": ["X", "Y"], "ks": ["p", "q"], "id": "a", "fixed": "$x"}


# --- pagination


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(f"i{n:02d}", n % 4 if n % 5 else None, n) for n in range(20)], "_id string, rank int, n int")


@pytest.mark.parametrize("sort", [None, -1, {"rank": 1}, {"rank": -1}, {"rank": 1, "n": -1}])
def test_pages_cover_everything_once(items, sort):
    store, seen, after = Collection(items), [], None
    everything = [r._id for r in store.paginate({}, sort=sort, limit=100, skip_total=True).rows.collect()]
    while True:
        page = store.paginate({}, sort=sort, limit=6, after_id=after, peek=True)
        ids = [r._id for r in page.rows.collect()]
        assert page.total == 20 and page.position == len(seen)
        seen += ids
        if not page.has_more:
            break
        after = ids[-1]
    assert seen == everything and len(set(seen)) == 20
    back = store.paginate({}, sort=sort, limit=4, before_id=everything[10])
    assert [r._id for r in back.rows.collect()] == everything[6:10] and back.position == 6


def test_page_hooks_and_filters(items):
    store = Collection(items)
    page = store.paginate({"$or": [{"n": {"$gt": 3}}, {"n": 1}]}, limit=3, after_id="i01", prepare=lambda d: {**d, "double": d["n"] * 2}, keep=lambda d: d["double"] % 4 == 0, show=lambda d: d["double"], peek=True)
    assert page.rows == [8, 12, 16] and page.has_more and page.total == 17
    column = store.paginate({}, limit=2, prepare=column_hook(lambda df: df.withColumn("double", F.col("n") * 2)), keep=F.col("double") > 10, skip_total=True)
    assert [r.double for r in column.rows.collect()] == [12, 14] and column.total is None
    missing = store.paginate({}, limit=3, after_id="none")
    assert missing.position == 1 and [r._id for r in missing.rows.collect()] == ["i00", "i01", "i02"]
    counted = store.paginate({}, limit=2, pipeline=lambda s: [s.match({"n": {"$gte": 15}})])
    assert counted.total == 5


def test_order_holds_through_a_pipeline(spark, monkeypatch):
    """Shuffles, joins, projections and limits of a pipeline leave the page's order; a sort of its own comes first."""
    df = spark.range(2000).select(F.format_string("d%04d", "id").alias("_id"), (F.col("id") * 7919 % 2000).alias("r"), (F.col("id") % 50).alias("k"), F.lit("mine").alias("_key0"))
    other = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).hint("merge")
    store = Collection(df, None, {"other": other})
    lookup = lambda s: [s.external_lookup("other", "k", "k", "o"), s.unwind("o"), s.project({"r": 1, "_key0": 1, "name": "$o.name"})]
    page = store.paginate({}, sort={"r": -1}, limit=8, pipeline=lookup)
    got = page.rows.collect()
    assert [r.r for r in got] == list(range(1999, 1991, -1)) and got[0]["_key0"] == "mine" and page.rows.columns == ["_id", "r", "_key0", "name"]
    following = store.paginate({}, sort={"r": -1}, limit=3, after_id=got[-1]["_id"], pipeline=lookup)
    assert [r.r for r in following.rows.collect()] == [1991, 1990, 1989] and following.position == 8
    back = store.paginate({}, sort={"r": -1}, limit=3, before_id=got[-1]["_id"], pipeline=lookup)
    assert [r.r for r in back.rows.collect()] == [1995, 1994, 1993]
    own = store.paginate({}, limit=3, pipeline=lambda s: [*lookup(s), s.sort({"name": 1})], skip_total=True)
    assert {r.name for r in own.rows.collect()} == {"n0"}
    checked = Collection(df, obj(r=number(min_value=5)), {"other": other}).paginate({}, sort={"r": 1}, limit=2, pipeline=lookup, show=lambda d: d["r"])
    assert checked.rows == [5, 6] and not checked.cut_short
    monkeypatch.setattr("docloom.operators.paginate.HOOK_SCAN", 10)
    short = store.paginate({}, limit=5, keep=lambda d: False, peek=True)
    assert short.rows == [] and short.cut_short and short.has_more


def test_lookups_by_value(spark):
    """Equal arrays and variables bring the same documents back; columns named as those used inside stay."""
    left = spark.createDataFrame([("a", ["x", "y"], 1, "k"), ("b", ["x", "y"], 1, "k"), ("c", None, None, "k"), ("d", ["z", None], 2, "k")], "_id string, ks array<string>, n int, _key string")
    right = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "key string, v int")
    run = lambda *stages: {r["_id"]: sorted(x.v for x in r.m) for r in Collection(left, None, {"r": right}).aggregate(list(stages)).collect()}
    assert run({"$lookup": {"from": "r", "localField": "ks", "foreignField": "key", "as": "m"}}) == {"a": [1, 2], "b": [1, 2], "c": [], "d": [3]}
    assert run({"$lookup": {"from": "r", "let": {"n": "$n"}, "pipeline": [{"$match": {"$expr": {"$gt": ["$v", "$$n"]}}}], "as": "m"}}) == {"a": [2, 3], "b": [2, 3], "c": [1, 2, 3], "d": [3]}  # null is below every value
    kept = Collection(left, None, {"r": right.withColumnRenamed("key", "k")}).aggregate([{"$lookup": {"from": "r", "localField": "_key", "foreignField": "k", "as": "m"}}])
    assert {r["_key"] for r in kept.collect()} == {"k"}


def test_several_types(spark):
    c = spark.createDataFrame([("collaborator:2", "C2"), ("collaborator:4", "C4")], "_id string, name string")
    v = spark.createDataFrame([("visitor:1", "V1", 1), ("visitor:3", None, 2)], "_id string, name string, n int")
    store = MultiCollection.union({"collaborator": c, "visitor": v}, {"collaborator": obj(name=string()), "visitor": obj(name=string(), n=number())})
    page = store.paginate(["collaborator", "visitor"], limit=9, natural_id_sort=True)
    assert [r._id for r in page.rows.collect()] == ["visitor:1", "collaborator:2", "collaborator:4"] and page.total == 4
    page = store.paginate(["collaborator", "visitor"], limit=9, natural_id_sort=True, after_id="collaborator:2")
    assert page.position == 2 and [r._id for r in page.rows.collect()] == ["collaborator:4"]
    with pytest.raises(ValueError, match="invalid id"):
        store.paginate("visitor", after_id="collaborator:2")
    with pytest.raises(InvalidDocumentError):
        store.find_one("visitor", {"_id": "visitor:3"})
    with pytest.raises(NotFoundError):
        store.get_by_id("visitor", "visitor:9")
    assert store.find("visitor").count() == 1 and store.count_documents("visitor").first()[0] == 2 and store.find_any({}).count() == 3


# --- schemas


def test_validity(spark):
    schema = obj(name=string(min_length=2), age=number(min_value=0, integer=True), tags=array(string(), max_length=2), kind=literal("a", "b"), note=nullable(string()), more=optional(record(number(), "^k")))
    df = spark.createDataFrame([(1, "Ann", 3.0, ["x"], "a", None, {"k1": 1.0}), (2, "A", 3.0, ["x"], "a", "n", None), (3, "Bob", 2.5, ["x"], "a", None, None), (4, "Bob", 2.0, ["x", "y", "z"], "b", None, None), (5, "Bob", 2.0, [], "c", None, None), (6, None, 2.0, [], "a", None, {"z": 1.0})], "id int, name string, age double, tags array<string>, kind string, note string, more map<string,double>")
    broken = {r.id: r.b for r in df.select("id", schema.violations(df.schema).alias("b")).collect()}
    assert broken == {1: [], 2: ["name"], 3: ["age"], 4: ["tags"], 5: ["kind"], 6: ["name", "more"]}
    store = Collection(df, schema)
    assert [r.id for r in store.find({}).collect()] == [1] and store.find_invalid({}).count() == 5 and store.find_one({"id": 2}) is None


def test_union_of_objects(spark):
    schema = obj(data=union(obj(type=literal("A"), a=string()), obj(type=literal("B"), b=number()), tag="type"), gone=null())
    df = spark.createDataFrame([(1, ("A", "x", None), None), (2, ("B", None, 1.0), None), (3, ("A", "x", 1.0), None), (4, ("B", None, None), None), (5, ("A", "x", None), "?")], "id int, data struct<type:string,a:string,b:double>, gone string")
    assert [r.id for r in df.where(schema.valid(df.schema)).collect()] == [1, 2]
    assert intersect(obj(a=string()), obj(b=number())).spark().names == ["a", "b"]


def test_unknown_checks_are_refused():
    with pytest.raises(SchemaError, match="unknown check"):
        integer(minimum=0)
    assert integer(min_value=0, positive=lambda c: c > 0)


def test_constraints_combine_and_differ():
    assert combined((("min_length", 2), ("min_length", 5), ("max_value", 9), ("max_value", 3), ("pattern", "a"), ("pattern", re.compile("b")))) == {"min_length": 5, "max_value": 3, "pattern": "(?=a)(?=b)"}
    a, b = obj(x=string(), y=number()), obj(x=string(max_length=3), z=boolean())
    assert difference(a, b) == {"added": ["properties.x.max_length", "properties.z.type", "required[1]"][:2], "removed": ["properties.y.type"], "changed": ["required[1]"]}
    assert same({"a": 1, "b": [1]}, {"b": [1], "a": 1}) and not same({"a": object()}, {"a": object()})
    assert re.match(dict(ref_id("user").checks)["pattern"], "user:1x!")
    assert array(string(), min_length=1).describe() == {"type": "array", "items": {"type": "string"}, "min_items": 1}


def test_index_plans():
    schema = obj(email=optional(string().indexed(unique=True, insensitive=True)), at=date().indexed(expire_after=60), inner=obj(k=integer().indexed(unique=True)))
    assert indexes(schema)["inner.k"] == Index(unique=True)
    target = wanted(schema)
    assert target["email_1"]["collation"] == {"locale": "en", "strength": 2}
    assert index_plan({"at_1": {"key": "at"}, "old_1": {"key": "old"}, "inner.k_1": target["inner.k_1"]}, target) == {"create": ["email_1"], "recreate": ["at_1"], "drop": ["old_1"], "keep": ["inner.k_1"]}
    assert wanted({"t": obj(s=string().indexed(unique=True, where={"live": True}))})["t_s"]["where"] == {"$and": [{"_type": {"$eq": "t"}}, {"live": True}]}


def test_vacuum(spark):
    schema = obj(at=date().indexed(expire_after=3600, where={"kind": "live"}), kind=string())
    now = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, now - dt.timedelta(hours=2), "live"), (2, now - dt.timedelta(hours=2), "kept"), (3, now - dt.timedelta(minutes=5), "live"), (4, None, "live")], "id int, at timestamp, kind string")
    assert [r.id for r in vacuum(df, schema, F.lit(now)).collect()] == [2, 3, 4]


# --- updates


def test_sanitizer():
    assert sanitize({"a": 1, "b": MISSING, "c": {"d": MISSING, "e": [1, MISSING]}}) == {"a": 1, "c": {"e": [1]}}
    with pytest.raises(UndefinedValueError):
        sanitize({"a": {"b": MISSING}}, "error")
    assert undefined_to_null({"a": MISSING, "b": [MISSING]}) == {"a": None, "b": [None]}
    assert split_set({"a": REMOVE, "b": partial(c=1, d=REMOVE), "e": {"f": 1}}) == {"$set": {"b.c": 1, "e": {"f": 1}}, "$unset": {"a": "", "b.d": ""}}


def test_update_paths(people):
    one = lambda update: updated(people, {"_id": "a"}, update).where("_id = 'a'").first()
    assert one({"$set": {"address": partial(zip=9)}}).address == ("Rome", 9)
    assert one({"$set": {"address": {"zip": 9}}}).address == (None, 9)
    assert one({"$unset": {"address.city": ""}, "$inc": {"age": 2}})[2:5] == (32, ["x", "y"], (None, 1))
    assert one({"$set": {"items.1.v": 7, "tags.2": "z"}}).tags == ["x", "y", "z"]
    assert [i.v for i in one({"$set": {"items.$[].v": 0}})["items"]] == [0, 0]
    assert one({"$addToSet": {"tags": {"$each": ["x", "w"]}}, "$pull": {"items": {"k": "p", "v": 1}}}).tags == ["x", "y", "w"]
    with pytest.raises(KeyError):
        one({"$set": {"nothing.here": 1}})
    assert updated(people, {"_id": "b"}, {"$set": {"address.city": "Bern"}}).where("_id = 'b'").first().address == ("Bern", None)


# --- the store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


USER = obj(name=string(), age=number(min_value=0), email=optional(string().indexed(unique=True, insensitive=True)), role=optional(string(), default="guest"))


def test_collection_round(store):
    users = MutableCollection(store, "users", USER)
    a, b = users.insert_many([{"name": "Ann", "age": 30, "email": "a@x"}, {"name": "Bob", "age": 20, "extra": MISSING}])
    assert users.get_by_id(a).role == "guest" and users.count() == 2
    with pytest.raises(InvalidDocumentError):
        users.insert_one({"name": "Cid", "age": -1})
    with pytest.raises(DuplicateKeyError):
        users.insert_one({"name": "Cid", "age": 1, "email": "A@X"})
    with pytest.raises(InvalidDocumentError):
        users.update_one({"_id": a}, {"$inc": {"age": -99}})
    assert users.update_one({"_id": a}, {"$inc": {"age": 1}}) == 1 and users.update_many({}, {"$set": {"role": "guest"}}) == 0
    assert users.update_one({"name": "Dan"}, {"$set": {"age": 3}, "$setOnInsert": {"role": "new"}}, upsert=True) == 1
    assert users.replace_one({"_id": b}, {"name": "Rob", "age": 1}) == 1 and users.get_by_id(b).name == "Rob"
    assert users.find_one_and_update({"_id": b}, {"$set": {"age": 5}}).age == 1 and users.get_by_id(b).age == 5
    with pytest.raises(ValueError, match="refused"):
        users.delete_many({})
    assert users.delete_many({"age": {"$lt": 4}}) == 1 and users.count() == 2
    users.bulk_write([{"insert_one": {"name": "E", "age": 9}}, {"delete_one": {"name": "E"}}])
    users.merge_frame(store.spark.createDataFrame([(b, 44.0), ("z", 1.0)], "_id string, age double").withColumn("name", F.lit("M")))
    assert users.get_by_id("z").name == "M" and users.get_by_id(b).age == 44
    users.rename("people")
    assert store.read("people").count() == 3 and "users" not in store.tables()


def test_units_of_work(store, spark):
    users, items = MutableCollection(store, "users", USER), MutableCollection(store, "items", obj(n=number()))
    version = store.version()
    with store.unit_of_work():
        users.insert_one({"name": "A", "age": 1})
        with store.unit_of_work():
            items.insert_one({"n": 1})
        assert users.count() == 1
    assert store.version() == version + 1
    with pytest.raises(RuntimeError), store.unit_of_work():
        users.insert_one({"name": "B", "age": 1})
        raise RuntimeError
    assert users.count() == 1
    other = Store(spark, store.root)
    with pytest.raises(WriteConflictError), store.unit_of_work():
        items.insert_one({"n": 2})
        other.create("third", items.df.schema)
    assert items.count() == 1


def test_retry():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise WriteConflictError
        return "done"

    pauses = []
    assert with_retry(work, sleep=pauses.append) == "done" and 0.05 <= pauses[0] <= 0.06 and 0.1 <= pauses[1] <= 0.12
    with pytest.raises(KeyError):
        with_retry(lambda: {}["x"], sleep=pauses.append)


def test_typed_store_and_changes(store, tmp_path):
    multi = MutableMulti(store, "multi", {"user": obj(name=string(), age=number()), "group": obj(name=string(), members=array(string()))})
    u = multi.insert_many("user", [{"name": "A", "age": 1}, {"name": "B", "age": 2}])
    group = multi.insert_one("group", {"name": "G", "members": u})
    folders = store.tables()["multi"]["parts"]["group"]
    assert multi.update_one("user", u[0], {"age": 5}) == 1 and multi.update_one("user", u[0], {}) == 0
    assert multi.update_many({"user": {u[1]: {"name": "BB"}}}) == 1
    assert store.tables()["multi"]["parts"]["group"] == folders
    for bad in (lambda: multi.update_one("user", "user:none", {"age": 1}), lambda: multi.delete_id("user", "user:none")):
        with pytest.raises(NotFoundError):
            bad()
    with pytest.raises(ValueError):
        multi.delete_any({})
    assert multi.delete_many("user", {"age": {"$gt": 4}}) == 1
    names = multi.reader.aggregate(lambda s: [s.match("group"), s.unwind("group", "members"), s.lookup("user", "members", "_id", "who"), s.unwind("user", "who"), s.project({"n": "$who.name"})])
    assert [r.n for r in names.collect()] == ["BB"]
    events, watcher = [], Watcher(store, str(tmp_path / "cp"))
    watcher.on("multi", "insert", lambda e: events.append(("insert", e["id"])))
    watcher.on("multi", "delete", lambda e: events.append(("delete", e["id"])))
    unknown = lambda e: None
    watcher.off("multi", "insert", unknown)
    watcher.start(available_now=True).awaitTermination()
    assert sorted(events[:2]) == sorted(("insert", i) for i in u) and events[2:] == [("insert", group), ("delete", u[0])]
    watcher.stop()
    assert change_log(store).where("operation = 'update'").count() == 2
    assert len(new_id()) == 26 and new_id()[:8] <= new_id()[:8]


def test_a_commit_cut_off_keeps_its_changes(spark, store, monkeypatch):
    """The records of a commit that ended before they were moved are moved by whoever opens the store next."""
    items = MutableCollection(store, "items", obj(n=number()))

    def cut(self):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "finish_changes", cut)
        items.insert_one({"_id": "a", "n": 1})
    assert items.count() == 1
    assert [r.id for r in change_log(Store(spark, store.root)).collect()] == ["a"]


def test_only_touched_files_are_written(store):
    items = MutableCollection(store, "items", obj(n=number()))
    for n in range(3):
        items.insert_many([{"_id": f"{n}{k}", "n": n} for k in range(4)])
    before = store.tables()["items"]["parts"][""]
    assert items.update_many({"n": 1}, {"$set": {"n": 9}}) == 4
    after = store.tables()["items"]["parts"][""]
    assert {before[0], before[2]} <= set(after) and before[1] not in after and items.count() == 12 and items.count({"n": 9}) == 4
    assert items.delete_many({"n": 0}) == 4 and items.count() == 8
    assert store.compact("items") == 1 and len(store.tables()["items"]["parts"][""]) == 1 and items.count() == 8
    assert store.expire(keep=1) >= 4 and items.count() == 8


def test_ids_are_unique_and_bulk_changes_fold(store, spark):
    items = MutableCollection(store, "items", obj(n=number(), t=optional(string())))
    items.insert_one({"_id": "a", "n": 1, "t": "x"})
    with pytest.raises(DuplicateKeyError):
        items.insert_one({"_id": "a", "n": 2})
    with pytest.raises(DuplicateKeyError):
        items.insert_frame(spark.createDataFrame([("b", 1.0), ("b", 2.0)], "_id string, n double"))
    twice = spark.createDataFrame([("a", 5.0, 2), ("a", 4.0, 1), ("c", 7.0, 1), ("c", 8.0, 3)], "_id string, n double, at int")
    items.merge_frame(twice, order="at")
    assert sorted((r["_id"], r.n, r.t) for r in items.df.collect()) == [("a", 5.0, "x"), ("c", 8.0, None)]
    with pytest.raises(Exception, match="two changes for id"):
        items.merge_frame(twice.drop("at"))
    items.merge_frame(spark.createDataFrame([("a", None)], "_id string, t string"), insert=False, with_nulls=True)
    assert items.get_by_id("a").t is None and items.get_by_id("a").n == 5


def test_a_dropped_table_closes_its_stream(store, tmp_path):
    items = MutableCollection(store, "items", obj(n=number()))
    watcher = Watcher(store, str(tmp_path / "cp"))
    watcher.on("items", "insert", print)
    query = watcher.start()
    items.drop()
    assert not query.isActive and not watcher.listeners


# --- migrations

ONE = Schemas(collections={"products": obj(name=string(), price=number())}, models={"posts": {"article": obj(title=string())}})
TWO = Schemas(collections={"products": obj(name=string(), price=number(), description=string())}, models={"posts": {"story": obj(title=string())}})


def first(b):
    b.create_collection("products").seed([{"_id": "p1", "name": "A", "price": 1}])
    b.create_instance("main", "posts").type("article").seed([{"title": "hi"}])


def second(b):
    b.collection("products").transform(lambda d: d.withColumn("description", F.lit("none")), lambda d: d.drop("description"))
    b.instances("posts").rename_type("article", "story")


M1 = Migration("2024_01_01_0000_aaaaaaaaaa@one", "one", None, ONE, first)
M2 = Migration("2024_01_02_0000_bbbbbbbbbb@two", "two", M1, TWO, second)


def test_chain():
    other = Migration("2024_01_03_0000_cccccccccc@three", "three", M1, TWO, second)
    report = check_chain([M2, M1])
    assert not report["errors"] and [m.id for m in report["order"]] == [M1.id, M2.id] and report["depth"] == 2
    assert check_chain([M1, M2, other], allow_branches=False)["errors"] and check_chain([M2])["errors"] and check_chain([M1, M1])["errors"]
    assert common_ancestor(M2, other) is M1 and is_ancestor(M1, M2) and not is_ancestor(M2, M1)
    assert is_after(M2.id, M1.id) and not is_after("unknown", M1.id) and re.fullmatch(r"\d{4}_\d\d_\d\d_\d{4}_\w{10}@add-x", migration_id("Add x!"))
    assert summary(M2)["depth"] == 1 and Model("posts", "1", ONE.models["posts"]).summary()["field_count"] == 1
    assert check_project(TWO, M2) == [] and check_project(ONE, M2)
    with pytest.raises(MigrationError):
        Migration("", "x", None, ONE, first)


def test_simulation(spark):
    results = engine.simulate_all(spark, [M1, M2])
    assert [r["errors"] for r in results] == [[], []]
    bad = Migration("2024_01_03_0000_cccccccccc@bad", "bad", M2, TWO, lambda b: b.collection("products").transform(lambda d: d.drop("name"), lambda d: d))
    assert engine.simulate(spark, bad)["errors"]
    lossy = Migration("2024_01_03_0000_dddddddddd@lossy", "lossy", M2, TWO, lambda b: b.collection("products").transform(lambda d: d.withColumn("price", F.lit(1.0)), lambda d: d))
    assert engine.simulate(spark, lossy)["warnings"] == ["products differs after the rollback"]
    final = Migration("2024_01_03_0000_eeeeeeeeee@final", "final", M2, Schemas(TWO.collections, {}, {"posts": {}}), lambda b: b.instances("posts").delete_type("story"))
    assert engine.simulate(spark, final)["warnings"] == ["the migration can't be reversed"]
    with pytest.raises(MigrationError):
        engine.reverse(spark, engine.mock_state(spark, TWO, 2, instances={"main": "posts"}), final)
    rows = engine.by_rows(lambda d: {**d, "price": d["price"] * 2}, spark.createDataFrame([], "name string, price double").schema)
    assert rows(spark.createDataFrame([("a", 2.0)], "name string, price double")).first().price == 4


def test_simulation_of_a_chain_meets_mock_rows(spark):
    """Each migration after the first meets rows that no seed has, also in tables that were empty."""

    def after(schemas, up, down=lambda d: d):
        return Migration("2024_01_02_0000_ffffffffff@next", "next", M1, schemas, lambda b: (b.collection("products").transform(up, down), schemas is TWO and b.instances("posts").rename_type("article", "story")))

    bad = after(TWO, lambda d: d.withColumn("description", F.when(F.col("price") <= 1, "cheap")), lambda d: d.drop("description"))
    assert [bool(r["errors"]) for r in engine.simulate_all(spark, [M1, bad])] == [False, True]
    lossy = after(ONE, lambda d: d.withColumn("price", F.lit(1.0)))
    for power in ("quick", "normal"):
        done = engine.simulate_all(spark, [M1, lossy], power)[-1]
        assert done["errors"] == [] and done["warnings"] == ["products differs after the rollback"]
        products = done["state"].collections["products"]
        assert products.count() == 1 + engine.POWER[power] and products.where("_id = 'p1'").count() == 1
        assert done["state"].instances["main"].count() == 1 + engine.POWER[power]
    empty = Migration("2024_01_01_0000_gggggggggg@empty", "empty", None, ONE, lambda b: b.create_collection("products"))
    fails = Migration("2024_01_02_0000_hhhhhhhhhh@fails", "fails", empty, ONE, lambda b: b.collection("products").transform(lambda d: d.withColumn("name", F.lit(None).cast("string")), lambda d: d))
    assert engine.simulate_all(spark, [empty, fails])[-1]["errors"] == ["collection products: 10 documents do not conform"]
    models = Migration("2024_01_02_0000_iiiiiiiiii@models", "models", empty, ONE, lambda b: b.instances("posts").type("article").transform(lambda d: d.withColumn("title", F.lit(None).cast("string")), lambda d: d))
    assert engine.simulate_all(spark, [empty, models])[-1]["errors"] == ["store mock:posts: 10 documents do not conform"]


def test_migrating_a_store(store):
    engine.migrate(store, M1)
    engine.migrate(store, M2)
    assert store.read("products").first().description == "none" and store.read("main").first()._id.startswith("story:")
    assert engine.pending(store, [M1, M2]) == [] and engine.catch_up_needed(store, [M1, M2])["main"] == {"missing": [], "orphaned": False}
    late = Migration("2024_01_03_0000_ffffffffff@late", "late", M2, TWO, lambda b: b.instances("posts").type("story").transform(lambda d: d.withColumn("title", F.upper("title")), lambda d: d))
    engine.migrate(store, late)
    # an instance that has missed it
    with store.unit_of_work():
        store.write("second", store.spark.createDataFrame([("story:1", "story", "low")], "_id string, _type string, title string"), typed=True)
        store.about("second", model="posts", created=M1.id)
    assert engine.catch_up_needed(store, [M1, M2, late])["second"]["missing"] == [M2.id, late.id]
    engine.catch_up(store, "second", [M1, M2, late])
    assert store.read("second").first().title == "LOW" and store.read("main").first().title == "HI"
    bad = Migration("2024_01_04_0000_gggggggggg@bad", "bad", late, TWO, lambda b: b.collection("products").transform(lambda d: d.drop("name"), lambda d: d))
    with pytest.raises(MigrationError):
        engine.migrate(store, bad)
    assert engine.states(store)[bad.id] == "failed" and "name" in store.read("products").columns
    engine.rollback(store, late)
    engine.rollback(store, M2)
    assert engine.states(store)[M2.id] == "reverted" and "description" not in store.read("products").columns and store.read("main").first()._id.startswith("article:")
    report = engine.status(store, [M1, M2])
    assert report["pending"] == [M2.id] and not report["healthy"] and engine.status(None, [])["healthy"]


def test_marking_a_store(spark, store):
    plain = Schemas(multi={"old": {"story": obj(title=string())}})
    a = Migration("2024_02_01_0000_aaaaaaaaaa@a", "a", None, plain, lambda b: b.create_multi("old").type("story").seed([{"title": "t"}]))
    b = Migration("2024_02_02_0000_bbbbbbbbbb@b", "b", a, Schemas(models={"posts": {"story": obj(title=string())}}), lambda x: x.mark_instance("old", "posts"))
    assert [r["errors"] for r in engine.simulate_all(spark, [a, b])] == [[], []]
    engine.migrate(store, a)
    engine.migrate(store, b)
    assert store.about("old")["model"] == "posts" and store.read("old").count() == 1


def test_command_line(spark, tmp_path):
    said = []
    run = lambda *a: (said.clear(), cli.main(["--folder", str(tmp_path), *a], said.append))[1]
    assert run("init") == 0 and run("init") == 1
    assert run("generate", "First one") == 0
    file = next((tmp_path / "migrations").glob("*.py"))
    text = file.read_text().replace("return builder", 'builder.create_collection("things").seed([{"_id": "t", "n": 1}])').replace("Schemas()", 'Schemas(collections={"things": obj(n=number())})').replace("import Migration, Schemas", "import Migration, Schemas\nfrom docloom.schema import number, obj")
    file.write_text(text)
    (tmp_path / "schemas.py").write_text('from docloom.migrate.model import Schemas\nfrom docloom.schema import number, obj\n\nschemas = Schemas(collections={"things": obj(n=number())})\n')
    assert run("check") == 0 and run("status") == 0 and "pending" in said[0]
    assert run("sync") == 1 and run("migrate") == 0 and run("check", "--check-indexes") == 0
    assert run("generate", "Second") == 0 and len(list((tmp_path / "migrations").glob("*.py"))) == 2
    assert run("status") == 0 and run("history") == 0 and said[-1] == "1 applied"
    assert run("rollback") == 1 and run("rollback", "--yes") == 0 and run("sync", "--force") == 0
    (tmp_path / "docloom.json").write_text('{"colour": 1}')
    assert run("status") == 1
