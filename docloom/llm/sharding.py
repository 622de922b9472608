"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a node's weight is the sum of the weights below it. A key
descends level by level: each child draws -ln(u) / weight from a hash of the key and the child's
path, and the smallest draw wins (the chance of a child is its share of the weight). A child's draw
depends on its own path and weight alone, so a change of weight moves keys only into or out of
the subtrees whose weights change. A shard added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import fresh, read_table

Tree = dict[str, dict[str, dict[int, float]]]

#: Groups that rows of a shard are numbered in; bounds the table of first numbers, not the rows.
SLOT_GROUPS = 4096

#: Copies of one row that are numbered at a time.
COPIES = 4096


def even_tree(shards: int, region: int = 4, rack: int = 2) -> Tree:
    """A tree of so many shards of weight 1, `rack` to a rack and `region` to a region."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(f"region{s // region}", {}).setdefault(f"rack{s % region // rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own."""
    return tree | {f"region-{shard}": {"rack0": {shard: weight}}}


def _uniform(key: Column, path: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(path, key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _child(key: Column, at: Column, nodes: list[tuple[str, dict[str, float]]]) -> Column:
    """The place of the child with the smallest draw, for the node at place `at` of nodes (path, children's weights); children without weight never win.

    Children at the same place of different nodes share one draw, whose path and weight are looked up: the code
    grows with the widest node and not with the tree.
    """
    draws = []
    for j in range(max((len(c) for _, c in nodes), default=0)):
        children = [(path, *list(c.items())[j]) if j < len(c) else (path, "", 0.0) for path, c in nodes]
        name = F.get(F.array(*(F.lit(f"{path}/{n}|" if w > 0 else None).cast("string") for path, n, w in children)), at)
        weight = F.get(F.array(*(F.lit(float(w)) for _, _, w in children)), at)
        draws.append(F.when(name.isNotNull(), F.struct((-F.log(_uniform(key, name)) / weight).alias("draw"), F.lit(j).alias("child"))))
    return F.array_min(F.array(*draws))["child"] if draws else F.lit(None).cast("int")


def shard_of(df: DataFrame, key: Column, tree: Tree, to: str) -> DataFrame:
    """df with the column `to`: the shard that each key descends to; a null key counts as the empty one."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    total = lambda x: sum(map(total, x.values())) if isinstance(x, dict) else x
    racks = [(r, k, shards) for r, own in tree.items() for k, shards in own.items()]
    leaves = [s for _, _, shards in racks for s in shards]
    region, rack = fresh(df, f"_{to}_region", f"_{to}_rack")

    def first_below(counts: list[int], at: Column) -> Column:
        """The place, in the level below, of the first child of the node at place `at`."""
        return F.get(F.array(*(F.lit(sum(counts[:i])) for i in range(len(counts)))), at)

    df = df.withColumn(region, _child(key, F.lit(0), [("", {r: total(x) for r, x in tree.items()})]))
    own = _child(key, F.col(region), [(r, {k: total(x) for k, x in below.items()}) for r, below in tree.items()])
    df = df.withColumn(rack, first_below([len(x) for x in tree.values()], F.col(region)) + own)
    own = _child(key, F.col(rack), [(f"{r}/{k}", {str(s): w for s, w in shards.items()}) for r, k, shards in racks])
    leaf = first_below([len(shards) for _, _, shards in racks], F.col(rack)) + own
    return df.withColumn(to, F.get(F.array(*map(F.lit, leaves)), leaf)).drop(region, rack)


def with_slots(counted: DataFrame, n: str, shard: str = "shard", groups: int = SLOT_GROUPS) -> DataFrame:
    """The rows that counted stands for, each with a slot: numbers from 0 without gaps in each shard, by the columns from the left.

    counted holds distinct rows and in column n how often each stands. Rows are numbered within `groups` hash groups of each
    shard, and a group's first number is the count of rows in the groups before it; no task holds a whole shard, and
    copies of one row are one row here, however many they are.
    """
    names = [c for c in counted.columns if c != n]
    group, to, of, first, own = fresh(counted, "_group", "_shard", "_of", "_first", "_own")
    order = [c for c in names if c != shard]
    text = F.concat_ws("|", F.lit("slot"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    rows = counted.withColumn(group, F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(groups)).cast("int"))
    sums = rows.groupBy(shard, group).agg(F.sum(n).alias(n))
    starts = sums.select(F.col(shard).alias(to), F.col(group).alias(of), (F.sum(n).over(Window.partitionBy(shard).orderBy(group)) - F.col(n)).alias(first))
    before = F.sum(n).over(Window.partitionBy(shard, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn(own, F.coalesce(before, F.lit(0)))
    # at most groups x shards rows; null-safe, so that no test for nulls is derived that would draw each shard again below the aggregation
    placed = numbered.join(F.broadcast(starts), F.col(shard).eqNullSafe(F.col(to)) & F.col(group).eqNullSafe(F.col(of)))
    last = F.col(n) - 1
    blocks = placed.withColumn(of, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    return blocks.select(*names, F.explode(F.sequence(F.col(first) + F.col(own) + F.col(of), F.col(first) + F.col(own) + F.least(F.col(of) + (COPIES - 1), last))).alias("slot"))


def shard_documents(docs: DataFrame, tree: Tree, larger: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the text's UTF-8 bytes plus 1, a null text counting as none; rows repeat as they do in
    docs, each with a slot of its own; other columns are not read. The law is `key`: doc_id and the
    tree decide. grown_shard is the shard in the tree `larger`, null without one.
    """
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))  # before the draws, so that their code has a stage of its own
    rows = shard_of(rows, key, tree, "shard")
    rows = shard_of(rows, key, larger, "grown_shard") if larger else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return with_slots(rows, "n").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SHARDS = 16
TREE = even_tree(SHARDS)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, and where they would be with one shard more."""
    return shard_documents(read_table(spark, sf_dir, "documents"), TREE, grown(TREE, SHARDS))


def _sql(tree: Tree, name: str) -> str:
    """SQL of tables name_region, name_rack and name (doc_id, shard): the descent, level by level."""
    rows = [(r, k, s, w) for r, racks in tree.items() for k, shards in racks.items() for s, w in shards.items()]
    leaves = ", ".join(f"('{r}', '{k}', {s}, {w})" for r, k, s, w in rows)
    draw = "-ln((('0x' || substr(md5({path} || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w"
    return f"""{name}_leaves(region, rack, shard, weight) AS (VALUES {leaves}),
{name}_region AS (SELECT doc_id, arg_min(region, {draw.format(path="'/' || region")}) AS region FROM (SELECT DISTINCT doc_id FROM documents), (SELECT region, sum(weight)::DOUBLE AS w FROM {name}_leaves GROUP BY region) GROUP BY doc_id),
{name}_rack AS (SELECT doc_id, region, arg_min(rack, {draw.format(path="region || '/' || rack")}) AS rack FROM {name}_region JOIN (SELECT region, rack, sum(weight)::DOUBLE AS w FROM {name}_leaves GROUP BY region, rack) USING (region) GROUP BY doc_id, region),
{name} AS (SELECT doc_id, arg_min(shard, {draw.format(path="region || '/' || rack || '/' || shard")}) AS shard FROM {name}_rack JOIN (SELECT region, rack, shard, weight::DOUBLE AS w FROM {name}_leaves) USING (region, rack) GROUP BY doc_id)"""


def _crc_table() -> list[int]:
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


_STEP = "xor({c} >> 4, t[({c} & 15) + 1])"

ORACLE = f"""WITH {_sql(TREE, "now")},
{_sql(grown(TREE, SHARDS), "later")},
crc AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: {_STEP.format(c="(" + _STEP.format(c="xor(c, b)") + ")")})) AS text_crc32
  FROM documents, (SELECT {_crc_table()}::BIGINT[] AS t))
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard::INTEGER AS shard, later.shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY ('0x' || substr(md5('slot|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || text_crc32 || '|' || later.shard), 1, 8))::BIGINT % {SLOT_GROUPS}, doc_id, size, text_crc32) - 1 AS slot
FROM crc JOIN now USING (doc_id) JOIN later USING (doc_id)"""

QUERIES = {"op9_sharding": op9_sharding}
ORACLE_SQL = {"op9_sharding": ORACLE}
