"""More queries of the driver: updates, deletes, constraints, migrations, change events, event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.migrate.engine import fold_log
from docloom.operators.constraints import expired, violations
from docloom.operators.updates import bulk_updated, deleted, deleted_ids, guard_delete, updated
from docloom.plans.stages import TYPE
from docloom.queries import LINES, PEOPLE, _orders_with_lines, people, query, read, shared_folder
from docloom.schema import Index
from docloom.streaming.changes import change_counts
from docloom.streaming.windows import distinct_events, sessions, tumbling

# --- updates and deletes


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def update_set_unset(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return updated(df, {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSES"}, "$unset": {"c_acctbal": ""}}).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 5 ELSE p_size END::INTEGER AS p_size FROM part")
def update_inc(spark, sf_dir):
    return updated(read(spark, sf_dir, "part"), {"p_size": {"$lt": 10}}, {"$inc": {"p_size": 5}}).select("p_partkey", "p_size")


_ITEMS = "(SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_quantity) AS qs FROM lineitem GROUP BY 1)"


@query(f"SELECT k, list_aggregate(list_transform(qs, lambda q, i: CASE WHEN i = 1 AND k % 2 = 0 THEN 0 ELSE q END), 'sum') AS total FROM {_ITEMS}")
def update_array_index(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.struct(x["l_quantity"].alias("q"))).alias("items"))
    out = updated(df, F.col("k") % 2 == 0, {"$set": {"items.0.q": 0}})
    return out.select("k", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["q"]).alias("total"))


@query(f"SELECT k, list_aggregate(list_transform(items, lambda x: x.q * 2), 'sum') AS total, len(items)::INTEGER + 1 AS n FROM {LINES}")
def update_array_all_push(spark, sf_dir):
    out = updated(_orders_with_lines(spark, sf_dir), None, {"$mul": {"items.$[].q": 2}, "$push": {"items": {"n": 99, "q": 0}}})
    return out.select("k", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["q"]).alias("total"), F.size("items").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_safe(spark, sf_dir):
    where = {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}}
    guard_delete(where)
    return deleted(read(spark, sf_dir, "orders"), where).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return deleted_ids(read(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey")


_BALANCES = "(SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 10000000, 1.0)"


@query(f"SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(b, c_acctbal) AS c_acctbal FROM customer FULL JOIN {_BALANCES} ON c_custkey = k")
def upsert_bulk(spark, sf_dir):
    sums = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    changes = sums.unionAll(spark.sql("SELECT 10000000L, 1.0D"))
    return bulk_updated(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", insert=True)


# --- constraints


@query("SELECT o_custkey::VARCHAR AS key, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    out = violations(read(spark, sf_dir, "orders"), "o_custkey", Index(unique=True))
    return out.select(F.col("key").cast("string").alias("key"), "n")


_MIXED = "(SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS brand FROM part)"


@query(f"SELECT lower(brand) AS key, count(*)::BIGINT AS n FROM {_MIXED} GROUP BY 1 HAVING count(*) > 1")
def unique_insensitive(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("brand"))
    return violations(df, "brand", Index(unique=True, insensitive=True))


@query("SELECT o_custkey AS key, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def partial_unique(spark, sf_dir):
    return violations(read(spark, sf_dir, "orders"), "o_custkey", Index(unique=True, where={"o_orderstatus": "P"}))


@query("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def ttl_expired(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    kind, now = df.agg(F.min("event_type"), F.max("ts").cast("timestamp") - F.expr("INTERVAL 12 HOURS")).first()
    return df.where(expired(df, "ts", Index(expire_after=3600, where={"event_type": kind}), F.lit(now))).select("event_id")


# --- migrations


@query(f"WITH {PEOPLE} SELECT CASE WHEN _type = 'supplier' THEN 'vendor' || substr(_id, 9) ELSE _id END AS _id, CASE WHEN _type = 'supplier' THEN 'vendor' ELSE _type END AS _type FROM people")
def id_prefix_rename(spark, sf_dir):
    from docloom.migrate.engine import _renamed

    return _renamed(people(spark, sf_dir).df, "supplier", "vendor", ids=True).select("_id", TYPE)


def _log(spark, sf_dir):
    """Events as a log of migrations: users are migrations, some operations fail."""
    return read(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("migration"), F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 3 == 0, "reverted").otherwise("applied").alias("operation"), F.col("event_id").alias("at"))


_LOG = "(SELECT 'm' || user_id::VARCHAR AS migration, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'reverted' ELSE 'applied' END AS operation, event_id AS seq FROM events)"


@query(f"SELECT migration, coalesce(arg_max(operation, seq) FILTER (operation <> 'failed'), 'failed') AS state FROM {_LOG} GROUP BY 1")
def op_log_state(spark, sf_dir):
    return fold_log(_log(spark, sf_dir), error=None)


@query(f"SELECT DISTINCT 'm' || c_custkey::VARCHAR AS migration FROM customer WHERE 'm' || c_custkey::VARCHAR NOT IN (SELECT migration FROM (SELECT migration, arg_max(operation, seq) FILTER (operation <> 'failed') AS s FROM {_LOG} GROUP BY 1) WHERE s = 'applied')")
def pending_ids(spark, sf_dir):
    every = read(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("migration")).distinct()
    return every.join(fold_log(_log(spark, sf_dir), error=None).where("state = 'applied'"), "migration", "left_anti")


# --- change events and event time


@query("SELECT 'events' AS ns, event_type AS operation, count(*)::BIGINT AS n FROM events GROUP BY 2")
def change_counts_by_type(spark, sf_dir):
    return change_counts(read(spark, sf_dir, "events").select(F.lit("events").alias("ns"), F.col("event_type").alias("operation")))


def _streamed(spark, sf_dir, name: str, build) -> DataFrame:
    """What a stream over a table's file has put out once it has read all of it; checkpoint and output lie in the shared folder."""
    source = spark.readStream.schema(read(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/{name}.parquet") else spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = build(source)
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    out = tumbling(read(spark, sf_dir, "events"), "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("SELECT floor(epoch(min(ts)))::BIGINT AS start, user_id, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session")
def window_session(spark, sf_dir):
    out = sessions(read(spark, sf_dir, "events"), "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return _streamed(spark, sf_dir, "events", lambda df: distinct_events(df, ["user_id", "event_type"], late="3650 days").select("user_id", "event_type"))


@query("SELECT event_id, user_id FROM events WHERE value > 50")
def stream_filter(spark, sf_dir):
    return _streamed(spark, sf_dir, "events", lambda df: df.where("value > 50").select("event_id", "user_id"))


@query("SELECT epoch(b)::BIGINT AS start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*)::BIGINT AS n FROM events GROUP BY 1) WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def stream_tumbling(spark, sf_dir):
    """Windows that the watermark has closed."""
    out = _streamed(spark, sf_dir, "events", lambda df: tumbling(df, "1 hour", [], F.count(F.lit(1)).alias("n"), late="0 seconds"))
    return out.select(F.unix_timestamp("start").alias("start"), "n")
