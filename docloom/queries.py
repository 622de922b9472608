"""The queries of the driver, each with the SQL that it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.collection import Collection, MultiCollection
from docloom.operators.paginate import column_hook
from docloom.schema import integer, literal, number, obj, optional, string

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events".split()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, a temporary one on one machine (tests), and an error on a cluster."""
    import tempfile

    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return place or tempfile.mkdtemp(prefix="docloom-")


def collection(spark: SparkSession, sf_dir: str, name: str, id_col: str | None = None, schema=None, **more: DataFrame) -> Collection:
    df = read(spark, sf_dir, name)
    if id_col:
        df = df.withColumn("_id", F.col(id_col))
    return Collection(df, schema, more)


def people(spark: SparkSession, sf_dir: str) -> MultiCollection:
    """Customers and suppliers in one store of two types."""
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.format_string("%08d", "c_custkey")).alias("_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supplier = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.format_string("%08d", "s_suppkey")).alias("_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    types = {"customer": obj(_id=string(), name=string(), nation=number(), balance=number(), segment=string()), "supplier": obj(_id=string(), name=string(), nation=number(), balance=number())}
    return MultiCollection.union({"customer": customer, "supplier": supplier}, types)


PEOPLE = """people AS (SELECT 'customer:' || lpad(c_custkey::VARCHAR, 8, '0') AS _id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS _type FROM customer
UNION ALL SELECT 'supplier:' || lpad(s_suppkey::VARCHAR, 8, '0'), s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier)"""

# --- filters


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_orderstatus": "F"}, project={"o_orderkey": 1, "o_custkey": 1})


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, project={"o_orderkey": 1, "o_orderpriority": 1})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def filter_range(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_totalprice": {"$gte": 100000, "$lte": 200000}}, project={"o_orderkey": 1, "o_totalprice": 1})


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_totalprice < 160000")
def filter_gt_lt(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_totalprice": {"$gt": 150000, "$lt": 160000}}, project={"o_orderkey": 1})


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice > 300000) AND o_orderpriority <> '5-LOW'")
def filter_or_and(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"$and": [{"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, {"o_orderpriority": {"$ne": "5-LOW"}}]}, project={"o_orderkey": 1})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 200000)")
def filter_nor(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 200000}}]}, project={"o_orderkey": 1})


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL")
def filter_exists(spark, sf_dir):
    return Collection(_events(spark, sf_dir)).find({"k": {"$exists": True}}, project={"event_id": 1})


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS DISTINCT FROM 7")
def filter_ne_null_aware(spark, sf_dir):
    return Collection(_events(spark, sf_dir)).find({"k": {"$ne": 7}}, project={"event_id": 1})


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def filter_dotted(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_acctbal").alias("balance")).alias("account")).alias("info"))
    return Collection(df).find({"info.segment": "BUILDING", "info.account.balance": {"$gt": 0}}, project={"c_custkey": 1})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 3000 AND l_quantity >= 10")
def filter_expr(spark, sf_dir):
    return collection(spark, sf_dir, "lineitem").find({"$expr": {"$and": [{"$gt": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, 3000]}, {"$gte": ["$l_quantity", 10]}]}}, project={"l_orderkey": 1, "l_linenumber": 1})


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part))")
def filter_array_element(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    first = df.agg(F.min(F.get("words", F.lit(0)))).first()[0]
    return Collection(df).find({"words": first}, project={"p_partkey": 1})


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M]') AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size % 5 = 1")
def filter_regex_nin_mod(spark, sf_dir):
    return collection(spark, sf_dir, "part").find({"p_type": {"$regex": "^[A-M]"}, "p_brand": {"$nin": ["Brand#11", "Brand#12"]}, "p_size": {"$mod": [5, 1]}}, project={"p_partkey": 1})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice >= 100000)")
def filter_not(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_totalprice": {"$not": {"$gte": 100000}}}, project={"o_orderkey": 1})


LINES = "(SELECT l_orderkey AS k, list(struct_pack(n := l_linenumber, q := l_quantity)) AS items FROM lineitem GROUP BY l_orderkey)"


def _orders_with_lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))).alias("items"))


@query(f"SELECT k FROM {LINES} WHERE len(list_filter(items, lambda x: x.n >= 3 AND x.q > 45)) > 0")
def filter_elem_match(spark, sf_dir):
    return Collection(_orders_with_lines(spark, sf_dir)).find({"items": {"$elemMatch": {"n": {"$gte": 3}, "q": {"$gt": 45}}}}, project={"k": 1})


@query(f"SELECT k FROM {LINES} WHERE len(items) = 4 AND len(list_filter(items, lambda x: x.q = 10)) > 0")
def filter_size_and_path(spark, sf_dir):
    return Collection(_orders_with_lines(spark, sf_dir)).find({"items": {"$size": 4}, "items.q": 10}, project={"k": 1})


# --- find, count, distinct, validity


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def find_projection_sort_limit_skip(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({}, sort={"o_totalprice": -1, "o_orderkey": 1}, skip=10, limit=20, project={"o_orderkey": 1, "o_totalprice": 1})


@query("SELECT count(*)::BIGINT AS count FROM orders WHERE o_orderstatus = 'O'")
def count_documents(spark, sf_dir):
    return collection(spark, sf_dir, "orders").count_documents({"o_orderstatus": "O"})


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal > 0")
def distinct_values(spark, sf_dir):
    return collection(spark, sf_dir, "customer").distinct("c_mktsegment", {"c_acctbal": {"$gt": 0}})


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part")
def distinct_array_values(spark, sf_dir):
    return Collection(read(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))).distinct("words")


def _customer_schema():
    return obj(c_custkey=integer(), c_name=string(pattern="^Customer#[0-9]+"), c_acctbal=number(min_value=0, max_value=9000), c_mktsegment=literal("BUILDING", "MACHINERY", "AUTOMOBILE"), note=optional(string()))


_VALID = "c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND regexp_matches(c_name, '^Customer#[0-9]+')"


@query(f"SELECT c_custkey FROM customer WHERE {_VALID}")
def find_valid(spark, sf_dir):
    return collection(spark, sf_dir, "customer", schema=_customer_schema()).find({}, project={"c_custkey": 1})


@query(f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10 AND NOT ({_VALID})")
def find_invalid(spark, sf_dir):
    return collection(spark, sf_dir, "customer", schema=_customer_schema()).find_invalid({"c_nationkey": {"$lt": 10}}).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, list_aggregate(list_filter([CASE WHEN c_acctbal NOT BETWEEN 0 AND 9000 THEN 'c_acctbal' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS broken FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
def schema_violations(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    broken = _customer_schema().violations(df.schema)
    return df.select("c_custkey", F.array_join(broken, ",").alias("broken")).where("broken <> ''")


# --- stages


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def stage_match(spark, sf_dir):
    return collection(spark, sf_dir, "nation").aggregate(lambda s: [s.match({"n_regionkey": 2}), s.project({"n_nationkey": 1, "n_name": 1})])


@query("SELECT p_partkey, p_brand AS brand, upper(p_type) AS kind FROM part")
def stage_project(spark, sf_dir):
    return collection(spark, sf_dir, "part").aggregate(lambda s: [s.project({"p_partkey": 1, "brand": "$p_brand", "kind": {"$toUpper": "$p_type"}})])


@query("SELECT r_regionkey FROM region")
def stage_project_exclude(spark, sf_dir):
    return collection(spark, sf_dir, "region", "r_regionkey").aggregate(lambda s: [s.project({"_id": 0, "r_name": 0})])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_returnflag = 'R'")
def stage_add_fields(spark, sf_dir):
    out = collection(spark, sf_dir, "lineitem").aggregate(lambda s: [s.match({"l_returnflag": "R"}), s.add_fields({"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}), s.project({"l_orderkey": 1, "l_linenumber": 1, "net": 1})])
    return out.withColumn("net", F.round("net", 6))


def _grouped(spark, sf_dir, **accumulators):
    return collection(spark, sf_dir, "lineitem").aggregate(lambda s: [s.group({"_id": "$l_returnflag", **accumulators})])


@query("SELECT l_returnflag AS _id, round(sum(l_quantity), 2) AS quantity, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def stage_group_sum(spark, sf_dir):
    return _grouped(spark, sf_dir, quantity={"$sum": "$l_quantity"}, n={"$count": {}}).withColumn("quantity", F.round("quantity", 2))


@query("SELECT l_returnflag AS _id, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def stage_group_avg(spark, sf_dir):
    return _grouped(spark, sf_dir, quantity={"$avg": "$l_quantity"}).withColumn("quantity", F.round("quantity", 6))


@query("SELECT l_returnflag AS _id, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def stage_group_min_max(spark, sf_dir):
    return _grouped(spark, sf_dir, low={"$min": "$l_extendedprice"}, high={"$max": "$l_extendedprice"})


@query("SELECT n_regionkey AS _id, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def stage_group_push(spark, sf_dir):
    out = collection(spark, sf_dir, "nation").aggregate(lambda s: [s.group({"_id": "$n_regionkey", "names": {"$push": "$n_name"}})])
    return out.withColumn("names", F.array_join(F.array_sort("names"), ","))


@query("SELECT c_nationkey AS _id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def stage_group_add_to_set(spark, sf_dir):
    out = collection(spark, sf_dir, "customer").aggregate(lambda s: [s.group({"_id": "$c_nationkey", "segments": {"$addToSet": "$c_mktsegment"}})])
    return out.withColumn("segments", F.array_join(F.array_sort("segments"), ","))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def stage_group_compound(spark, sf_dir):
    out = collection(spark, sf_dir, "lineitem").aggregate([{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}])
    return out.select("_id.flag", "_id.status", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def stage_sort_limit(spark, sf_dir):
    return collection(spark, sf_dir, "orders").aggregate(lambda s: [s.sort({"o_totalprice": -1, "o_orderkey": 1}), s.limit(25), s.project({"o_orderkey": 1, "o_totalprice": 1})])


@query("SELECT n_nationkey FROM nation ORDER BY n_name LIMIT 10 OFFSET 5")
def stage_skip(spark, sf_dir):
    return collection(spark, sf_dir, "nation").aggregate(lambda s: [s.sort({"n_name": 1}), s.skip(5), s.limit(10), s.project({"n_nationkey": 1})])


@query("SELECT count(*)::BIGINT AS urgent FROM orders WHERE o_orderpriority = '1-URGENT'")
def stage_count(spark, sf_dir):
    return collection(spark, sf_dir, "orders").aggregate(lambda s: [s.match({"o_orderpriority": "1-URGENT"}), s.count("urgent")])


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def stage_unwind(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"))
    return Collection(df).aggregate(lambda s: [s.unwind("$word")])


# --- lookups


@query("SELECT a.n_nationkey, count(b.n_nationkey)::BIGINT AS n FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1")
def lookup_self(spark, sf_dir):
    out = collection(spark, sf_dir, "nation").aggregate(lambda s: [s.lookup("n_regionkey", "n_regionkey", "peers"), s.project({"n_nationkey": 1, "n": {"$size": "$peers"}})])
    return out.withColumn("n", F.col("n").cast("long"))


def _customers(spark, sf_dir):
    return collection(spark, sf_dir, "customer", orders=read(spark, sf_dir, "orders"), nation=read(spark, sf_dir, "nation"))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_external(spark, sf_dir):
    out = _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "orders"), s.project({"c_custkey": 1, "n": {"$size": "$orders"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY 1")
def lookup_external_pipeline(spark, sf_dir):
    out = _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "large", pipeline=[{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$project": {"o_orderkey": 1}}]), s.project({"c_custkey": 1, "n": {"$size": "$large"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY r), '') AS top FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON c_custkey = o_custkey AND r <= 3 GROUP BY 1")
def lookup_pipeline_top(spark, sf_dir):
    out = _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "top", pipeline=[{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}]), s.project({"c_custkey": 1, "top": "$top.o_orderkey"})])
    return out.withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1")
def lookup_let_theta(spark, sf_dir):
    pipeline = [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$key"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$balance", 20]}]}]}}}]
    out = _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", None, None, "above", let={"key": "$c_custkey", "balance": "$c_acctbal"}, pipeline=pipeline), s.project({"c_custkey": 1, "n": {"$size": "$above"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def lookup_unwind_inner(spark, sf_dir):
    return _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "order"), s.unwind("order"), s.project({"c_custkey": 1, "o_orderkey": "$order.o_orderkey"})])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def lookup_semi(spark, sf_dir):
    return _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "found", pipeline=[{"$match": {"o_orderstatus": "P"}}]), s.match({"found": {"$ne": []}}), s.project({"c_custkey": 1})])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def lookup_anti(spark, sf_dir):
    return _customers(spark, sf_dir).aggregate(lambda s: [s.external_lookup("orders", "c_custkey", "o_custkey", "found", pipeline=[{"$match": {"o_orderstatus": "P"}}]), s.match({"found": {"$size": 0}}), s.project({"c_custkey": 1})])


_ENTRIES = """entries AS (SELECT o_orderkey AS k, 'customer:' || lpad(o_custkey::VARCHAR, 8, '0') AS ref FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT l_orderkey, 'supplier:' || lpad(l_suppkey::VARCHAR, 8, '0') FROM lineitem WHERE l_linenumber = 1)"""


def _entries(spark, sf_dir):
    a = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("customer:"), F.format_string("%08d", "o_custkey")).alias("ref"))
    b = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("supplier:"), F.format_string("%08d", "l_suppkey")).alias("ref"))
    return a.unionAll(b)


@query(f"WITH {PEOPLE}, {_ENTRIES} SELECT k, ref, name FROM entries JOIN people ON ref = people._id")
def lookup_any(spark, sf_dir):
    entries = Collection(_entries(spark, sf_dir), tables={"people": people(spark, sf_dir).df})
    return entries.aggregate(lambda s: [s.external_lookup("people", "ref", "_id", "who"), s.unwind("who"), s.project({"k": 1, "ref": 1, "name": "$who.name"})])


@query(f"WITH {PEOPLE} SELECT a._id, count(b._id)::BIGINT AS n FROM people a LEFT JOIN people b ON a.nation = b.nation AND b._type = 'supplier' WHERE a._type = 'customer' GROUP BY 1")
def lookup_typed(spark, sf_dir):
    out = people(spark, sf_dir).aggregate(lambda s: [s.match("customer"), s.lookup("supplier", "nation", "nation", "suppliers"), s.project({"n": {"$size": "$suppliers"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {PEOPLE} SELECT a._id, count(b._id)::BIGINT AS n FROM people a LEFT JOIN people b ON a.nation = b.nation WHERE a._type = 'supplier' GROUP BY 1")
def lookup_any_type(spark, sf_dir):
    out = people(spark, sf_dir).aggregate(lambda s: [s.match("supplier"), s.any_lookup("nation", "nation", "neighbours"), s.project({"n": {"$size": "$neighbours"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT n_name AS _id, count(*)::BIGINT AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'A' GROUP BY 1")
def lookup_multi_hop(spark, sf_dir):
    lines = collection(spark, sf_dir, "lineitem", orders=read(spark, sf_dir, "orders"), customer=read(spark, sf_dir, "customer"), nation=read(spark, sf_dir, "nation"))
    out = lines.aggregate(lambda s: [s.match({"l_returnflag": "A"}), s.external_lookup("orders", "l_orderkey", "o_orderkey", "o"), s.unwind("o"), s.external_lookup("customer", "o.o_custkey", "c_custkey", "c"), s.unwind("c"), s.external_lookup("nation", "c.c_nationkey", "n_nationkey", "n"), s.unwind("n"), s.group({"_id": "$n.n_name", "lines": {"$sum": 1}})])
    return out.withColumn("lines", F.col("lines").cast("long"))


@query("SELECT n_nationkey, count(*)::BIGINT AS n FROM (SELECT n_nationkey, unnest(list_distinct([n_regionkey, (n_regionkey + 1) % 5])) AS k FROM nation) JOIN region ON k = r_regionkey GROUP BY 1")
def lookup_array_keys(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").withColumn("keys", F.array(F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5))
    out = Collection(nations, tables={"region": read(spark, sf_dir, "region")}).aggregate(lambda s: [s.external_lookup("region", "keys", "r_regionkey", "regions"), s.project({"n_nationkey": 1, "n": {"$size": "$regions"}})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT n_name AS nation, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, nation LIMIT 10")
def pipeline_top_nations(spark, sf_dir):
    orders = collection(spark, sf_dir, "orders", customer=read(spark, sf_dir, "customer"), nation=read(spark, sf_dir, "nation"))
    out = orders.aggregate(lambda s: [s.match({"o_orderstatus": "F"}), s.external_lookup("customer", "o_custkey", "c_custkey", "c"), s.unwind("c"), s.external_lookup("nation", "c.c_nationkey", "n_nationkey", "n"), s.unwind("n"), s.group({"_id": "$n.n_name", "n": {"$sum": 1}}), s.sort({"n": -1, "_id": 1}), s.limit(10), s.project({"_id": 0, "nation": "$_id", "n": 1})])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def flagship_segments(spark, sf_dir):
    orders = collection(spark, sf_dir, "orders", customer=read(spark, sf_dir, "customer"))
    out = orders.aggregate(lambda s: [s.external_lookup("customer", "o_custkey", "c_custkey", "c"), s.unwind("c"), s.group({"_id": "$c.c_mktsegment", "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}}), s.sort({"total": -1}), s.project({"_id": 0, "segment": "$_id", "total": 1, "n": 1})])
    return out.withColumn("total", F.round("total", 2)).withColumn("n", F.col("n").cast("long"))


# --- expressions


def _expr(spark, sf_dir, name, key, **fields):
    return collection(spark, sf_dir, name).aggregate(lambda s: [s.project({key: 1, **fields})])


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' ELSE 'small' END AS size FROM orders")
def expr_cond(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", "o_orderkey", size={"$cond": [{"$gte": ["$o_totalprice", 200000]}, "large", "small"]})


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity)::BIGINT AS unit, round(l_quantity * l_tax + 1, 4) AS taxed FROM lineitem")
def expr_arith(spark, sf_dir):
    out = _expr(spark, sf_dir, "lineitem", "l_orderkey", l_linenumber=1, unit={"$floor": {"$divide": ["$l_extendedprice", "$l_quantity"]}}, taxed={"$add": [{"$multiply": ["$l_quantity", "$l_tax"]}, 1]})
    return out.withColumn("taxed", F.round("taxed", 4))


@query("SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, n_name || '/' || n_regionkey::VARCHAR AS both FROM nation")
def expr_upper(spark, sf_dir):
    return _expr(spark, sf_dir, "nation", "n_nationkey", up={"$toUpper": "$n_name"}, low={"$toLower": "$n_name"}, both={"$concat": ["$n_name", "/", {"$toString": "$n_regionkey"}]})


@query("SELECT c_custkey, substr(c_name, instr(c_name, '#') + 1, 20) AS tail, instr(c_name, '#')::INTEGER - 1 AS at FROM customer")
def expr_substr(spark, sf_dir):
    return _expr(spark, sf_dir, "customer", "c_custkey", tail={"$substr": ["$c_name", {"$add": [{"$indexOfCP": ["$c_name", "#"]}, 1]}, 20]}, at={"$indexOfCP": ["$c_name", "#"]})


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, len(string_split(p_name, ' '))::INTEGER AS n FROM part")
def expr_array_elem(spark, sf_dir):
    words = {"$split": ["$p_name", " "]}
    return _expr(spark, sf_dir, "part", "p_partkey", first={"$arrayElemAt": [words, 0]}, last={"$arrayElemAt": [words, -1]}, n={"$size": words})


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k FROM events")
def expr_if_null(spark, sf_dir):
    return Collection(_events(spark, sf_dir)).aggregate(lambda s: [s.project({"event_id": 1, "k": {"$ifNull": ["$k", -1]}})])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size, len(list_filter(string_split(p_name, ' '), lambda x: len(x) > 4))::INTEGER AS long_words FROM part")
def expr_switch_filter(spark, sf_dir):
    size = {"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": "S"}, {"case": {"$lt": ["$p_size", 30]}, "then": "M"}], "default": "L"}}
    return _expr(spark, sf_dir, "part", "p_partkey", size=size, long_words={"$size": {"$filter": {"input": {"$split": ["$p_name", " "]}, "as": "w", "cond": {"$gt": [{"$strLenCP": "$$w"}, 4]}}}})


# --- pagination


def _orders(spark, sf_dir):
    return collection(spark, sf_dir, "orders", "o_orderkey")


_PAGE = ["_id", "o_totalprice"]


def _middle(spark, sf_dir, of=0.5):
    """An order's id near the middle."""
    return read(spark, sf_dir, "orders").agg((F.max("o_orderkey") * of).cast("long")).first()[0]


_ANCHOR = "(SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= (SELECT floor(max(o_orderkey) * 0.5) FROM orders))"


def _anchor(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.col("o_orderkey") >= _middle(spark, sf_dir)).agg(F.min("o_orderkey")).first()[0]


@query("SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 50")
def page_first(spark, sf_dir):
    return _orders(spark, sf_dir).paginate({"o_orderstatus": "F"}, limit=50, skip_total=True).rows.select(_PAGE)


@query(f"SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey > {_ANCHOR} ORDER BY 1 LIMIT 50")
def page_after(spark, sf_dir):
    return _orders(spark, sf_dir).paginate({}, limit=50, after_id=_anchor(spark, sf_dir), skip_total=True).rows.select(_PAGE)


@query(f"SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey < {_ANCHOR} ORDER BY 1 DESC LIMIT 50")
def page_before(spark, sf_dir):
    return _orders(spark, sf_dir).paginate({}, limit=50, before_id=_anchor(spark, sf_dir), skip_total=True).rows.select(_PAGE)


@query(f"SELECT o_orderkey AS _id, o_totalprice FROM orders, (SELECT o_orderpriority AS p, o_orderkey AS k FROM orders WHERE o_orderkey = {_ANCHOR}) WHERE o_orderpriority < p OR o_orderpriority = p AND o_orderkey > k ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40")
def page_desc_ties(spark, sf_dir):
    return _orders(spark, sf_dir).paginate({}, limit=40, sort={"o_orderpriority": -1}, after_id=_anchor(spark, sf_dir), skip_total=True).rows.select(_PAGE)


@query(f"SELECT count(*)::BIGINT AS total, (count(*) - count(*) FILTER (o_totalprice > p OR o_totalprice = p AND o_orderkey > k))::BIGINT AS position FROM orders, (SELECT o_totalprice AS p, o_orderkey AS k FROM orders WHERE o_orderkey = {_ANCHOR})")
def page_position(spark, sf_dir):
    page = _orders(spark, sf_dir).paginate({}, limit=10, sort={"o_totalprice": 1}, after_id=_anchor(spark, sf_dir))
    return spark.createDataFrame([(page.total, page.position)], "total long, position long")


@query(f"SELECT count(*)::BIGINT AS total, greatest(0, count(*) FILTER (o_orderkey < k) - least(10, count(*) FILTER (o_orderkey < k)))::BIGINT AS position FROM orders, (SELECT {_ANCHOR} AS k)")
def page_position_before(spark, sf_dir):
    page = _orders(spark, sf_dir).paginate({}, limit=10, before_id=_anchor(spark, sf_dir))
    return spark.createDataFrame([(page.total, page.position)], "total long, position long")


@query("SELECT count(*)::BIGINT AS total FROM orders WHERE o_orderstatus = 'O' AND floor(o_totalprice / 1000) >= 150")
def page_total_pipeline(spark, sf_dir):
    page = _orders(spark, sf_dir).paginate({"o_orderstatus": "O"}, limit=10, pipeline=lambda s: [s.add_fields({"thousands": {"$floor": {"$divide": ["$o_totalprice", 1000]}}}), s.match({"thousands": {"$gte": 150}})])
    return spark.createDataFrame([(page.total,)], "total long")


@query("SELECT o_orderkey AS _id, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 100 ORDER BY 1 LIMIT 30")
def page_pipeline_lookup(spark, sf_dir):
    orders = collection(spark, sf_dir, "orders", "o_orderkey", customer=read(spark, sf_dir, "customer"))
    page = orders.paginate({"o_orderkey": {"$gt": 100}}, limit=30, pipeline=lambda s: [s.external_lookup("customer", "o_custkey", "c_custkey", "c"), s.unwind("c"), s.add_fields({"segment": "$c.c_mktsegment"})], skip_total=True)
    return page.rows.select("_id", "segment")


@query("SELECT o_orderkey AS _id, o_totalprice AS price, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def page_pipeline_unsorted(spark, sf_dir):
    """A page in descending order through a shuffled lookup that sorts nothing itself."""
    orders = collection(spark, sf_dir, "orders", "o_orderkey", customer=read(spark, sf_dir, "customer").hint("merge"))
    page = orders.paginate({"o_totalprice": {"$gt": 1000}}, limit=25, sort={"o_totalprice": -1}, pipeline=lambda s: [s.external_lookup("customer", "o_custkey", "c_custkey", "c"), s.unwind("c"), s.add_fields({"segment": "$c.c_mktsegment"})], skip_total=True)
    return page.rows.selectExpr("_id", "o_totalprice AS price", "segment")


@query("SELECT o_orderkey AS _id, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice >= 50000 ORDER BY o_totalprice, o_orderkey LIMIT 20")
def page_pipeline_invalid(spark, sf_dir):
    """Documents that don't conform are left out of a page with a pipeline too."""
    orders = collection(spark, sf_dir, "orders", "o_orderkey", obj(o_totalprice=number(min_value=50000)))
    page = orders.paginate({}, limit=20, sort={"o_totalprice": 1}, pipeline=lambda s: [s.add_fields({"twice": {"$multiply": ["$o_totalprice", 2]}})], skip_total=True)
    return page.rows.select("_id", "twice")


@query("SELECT o_orderkey AS _id, c_mktsegment AS segment FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def page_pipeline_inner_limit(spark, sf_dir):
    """A limit between the sort and a lookup takes the first rows of the order."""
    orders = collection(spark, sf_dir, "orders", "o_orderkey", customer=read(spark, sf_dir, "customer"))
    page = orders.paginate({}, limit=10, sort={"o_totalprice": -1}, pipeline=lambda s: [s.limit(40), s.external_lookup("customer", "o_custkey", "c_custkey", "c"), s.unwind("c"), s.project({"segment": "$c.c_mktsegment"})], skip_total=True)
    return page.rows.select("_id", "segment")


@query("SELECT o_custkey AS _id, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest, list(o_totalprice ORDER BY o_totalprice DESC)[1] AS price FROM orders GROUP BY 1")
def stage_group_first_last(spark, sf_dir):
    """$first, $last and $push after a sort follow it."""
    rows = collection(spark, sf_dir, "orders").aggregate([{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_custkey", "dearest": {"$first": "$o_orderkey"}, "cheapest": {"$last": "$o_orderkey"}, "prices": {"$push": "$o_totalprice"}}}])
    return rows.select("_id", "dearest", "cheapest", F.col("prices")[0].alias("price"))


@query("SELECT o_orderkey AS _id, 1 AS more, 0 AS cut_short FROM orders WHERE o_orderkey > 7 ORDER BY 1 LIMIT 5")
def page_peek_after_wins(spark, sf_dir):
    """One row more is looked for; after wins where both anchors are given."""
    page = collection(spark, sf_dir, "orders", "o_orderkey").paginate({}, limit=5, after_id=7, before_id=100, peek=True, skip_total=True)
    return page.rows.select("_id", F.lit(int(bool(page.has_more))).alias("more"), F.lit(int(page.cut_short)).alias("cut_short"))


@query(f"WITH {PEOPLE} SELECT _id, name FROM people ORDER BY substr(_id, instr(_id, ':') + 1), _id LIMIT 30")
def page_natural_id(spark, sf_dir):
    return people(spark, sf_dir).paginate(["customer", "supplier"], limit=30, natural_id_sort=True, skip_total=True).rows.select("_id", "name")


@query(f"WITH {PEOPLE} SELECT _id, balance FROM people WHERE balance > 0 ORDER BY balance DESC, _id LIMIT 40")
def page_cross_type(spark, sf_dir):
    return people(spark, sf_dir).paginate(["customer", "supplier"], {"balance": {"$gt": 0}}, limit=40, sort={"balance": -1}, skip_total=True).rows.select("_id", "balance")


@query("SELECT o_orderkey AS _id, 'order ' || o_orderkey::VARCHAR AS title FROM orders WHERE o_totalprice * 2 > 500000 ORDER BY 1 LIMIT 25")
def page_hooks(spark, sf_dir):
    prepare = column_hook(lambda df: df.withColumn("double", F.col("o_totalprice") * 2))
    show = column_hook(lambda df: df.select("_id", F.concat(F.lit("order "), F.col("_id").cast("string")).alias("title")))
    return _orders(spark, sf_dir).paginate({}, limit=25, prepare=prepare, keep=F.col("double") > 500000, show=show, skip_total=True).rows


@query("SELECT c_custkey AS _id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def page_nested_sort(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), F.struct(F.col("c_acctbal").alias("balance")).alias("data"))
    return Collection(df).paginate({}, limit=15, sort={"data.balance": -1}, skip_total=True).rows.select("_id", "data.balance")


# --- several types


@query(f"WITH {PEOPLE} SELECT _id, _type FROM people WHERE (_type = 'customer' AND segment = 'BUILDING' AND balance > 5000) OR (_type = 'supplier' AND nation IN (1, 2, 3))")
def multi_find_any(spark, sf_dir):
    return people(spark, sf_dir).find_any({"$or": [{"_type": "customer", "segment": "BUILDING", "balance": {"$gt": 5000}}, {"_type": "supplier", "nation": {"$in": [1, 2, 3]}}]}, project={"_id": 1, "_type": 1})


@query(f"WITH {PEOPLE} SELECT _type AS _id, count(*)::BIGINT AS n FROM people GROUP BY 1")
def multi_type_counts(spark, sf_dir):
    out = people(spark, sf_dir).aggregate([{"$group": {"_id": "$_type", "n": {"$sum": 1}}}])
    return out.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {PEOPLE} SELECT _type, count(*)::BIGINT AS n, count(*) FILTER (balance BETWEEN 0 AND 9000)::BIGINT AS valid FROM people GROUP BY 1")
def schema_conformance(spark, sf_dir):
    store = people(spark, sf_dir)
    types = {k: obj(_id=string(), name=string(), balance=number(min_value=0, max_value=9000)) for k in store.types}
    return MultiCollection(store.df, types).df.groupBy("_type").agg(F.count("*").alias("n"), F.sum(F.when(MultiCollection(store.df, types).valid, 1).otherwise(0)).cast("long").alias("valid"))


