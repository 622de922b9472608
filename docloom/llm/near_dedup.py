"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct shingles of five words. Documents with equal sets are one node. A tree sorts
the nodes by their signature in an order of its places that is the tree's own; neighbours whose longest common prefix has
a depth or more are a run of the sorted order, a region. In a region, the agreement of whole signatures tells which
nodes may be linked (LENIENT, far below the threshold), and what hangs together this way is compared by full sets, once where all regions
together make a group of at most REGION_NODES nodes.

Regions begin at depth 2. One of more than REGION_NODES nodes is mostly a cluster of near copies, or text that many share. Its nodes are
first compared in parts, each together with the region's first node. What then doesn't belong to the region's largest component is
compared with all of the region in pairs of blocks, if that makes few rows (ROWS_WITH_ALL); else all nodes of the region go on to the next depth of LEVELS, in
more trees than before, so that a pair at the threshold is lost with a probability below 2e-6 at any depth (`miss`). At the last
depth the rest is compared whatever its size. The cost is in proportion to the nodes except where a region of the last depth
holds many components, and no pair of a region is lost.

A cluster stands in a region of nearly every tree. Nodes that are in one component already aren't compared again, and groups that share
nodes are merged before full sets are fetched. Tables of few rows (groups, components) are worked on by the driver; larger ones stay tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, checkpoint, lean, on_driver, read_table, text_batches
from docloom.llm.components import components_of, connected_components

SHINGLE = 5
PERCENT = 75
VALUES = 128
#: (depth, trees): the depths that regions are cut at, and how many trees share the work at each.
LEVELS = [(2, 20), (4, 56), (6, 160)]
REGION_NODES = 1024
#: Rows for each node of a region in pairs of blocks, up to which they are taken instead of the next depth, whose trees make more.
ROWS_WITH_ALL = 4
#: Shingles of a group that one task compares; heavier groups are compared in pairs of blocks.
GROUP_SHINGLES = 2_000_000
MAX_BROADCAST_ROWS = 250_000
LENIENT = 0.5
#: Multiplier of the rolling hash of a shingle's words.
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _salts() -> tuple[np.ndarray, np.ndarray]:
    numbers = _mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * BASE)
    return numbers[:VALUES], numbers[VALUES:] | np.uint64(1)


FLIP, TIMES = _salts()


def _orders() -> np.ndarray:
    """By tree, the places of the signature that its order looks at first; the two at the front are a tree's own as long as there are places."""
    out = []
    for tree in range(max(t for _, t in LEVELS)):
        front = [2 * tree, 2 * tree + 1] if 2 * tree < VALUES else []
        rest = np.argsort(_mix(np.arange(tree * VALUES, (tree + 1) * VALUES, dtype=np.uint64) * BASE)).tolist()
        out.append([*front, *(p for p in rest if p not in front)][: max(d for d, _ in LEVELS)])
    return np.array(out)


ORDERS = _orders()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles: A-Z in lower case, words between ASCII white space; with fewer words, one of them all."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = hashes[:n].copy()
    for j in range(1, size):
        out = out * BASE + hashes[j : n + j]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values, of each the 16 bits below the upper 32: the uppermost of a minimum are nearly always zero."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        x = (hashes[i : i + 4096, None] ^ FLIP) * TIMES
        x ^= x >> np.uint64(31)
        np.minimum(least, x.min(0), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def prefixes(signatures: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """A number for the first `depth` values of each signature (row) in the order of each tree (column)."""
    tree = _mix(np.arange(1, trees + 1, dtype=np.uint64) * BASE + np.uint64(depth))
    out = np.repeat(tree[None], len(signatures), 0)
    for k in range(depth):
        out = (out + signatures[:, ORDERS[:trees, k]] + np.uint64(1)) * BASE
        out ^= out >> np.uint64(32)
    return _mix(out).view(np.int64)


def miss(s: float, depth: int, trees: int) -> float:
    """The probability that two sets of similarity s share no prefix in any tree: trees draw from the same places, of which a random number agree."""
    agree = (comb(VALUES, k) * s**k * (1 - s) ** (VALUES - k) for k in range(VALUES + 1))
    return sum(p * (1 - comb(k, depth) / comb(VALUES, depth)) ** trees for k, p in enumerate(agree))


def labels_of(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by a symmetric matrix of links."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i], front = i, linked[i] & (label < 0)
            while front.any():
                label[front] = i
                front = linked[front].any(0) & (label < 0)
    return label


def _similar(low: np.ndarray, share: float) -> np.ndarray:
    """Which rows agree in so large a share of their bytes, as a matrix."""
    n = len(low)
    out = np.zeros((n, n), bool)
    for i in range(0, n, 64):
        same = (low[i : i + 64, None, :] == low[None]).sum(2, dtype=np.int32)
        out[i : i + 64] = same / low.shape[1] >= share
    return out


def linked_exactly(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets have 100 * intersection >= percent * union, from full sets, as a matrix."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    if n == 2:
        both = np.array([[sizes[0], 0], [0, sizes[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        both, width = np.zeros((n, n), np.int64), int((count > 1).sum())
        step = max(1, 4_000_000 // n)
        for at in range(0, width, step):  # dense columns, a bounded number at a time
            own = (column >= at) & (column < at + step)
            dense = np.zeros((n, min(step, width - at)), np.float32)
            dense[row[own], column[own] - at] = 1
            both += np.rint(dense @ dense.T).astype(np.int64)
    np.fill_diagonal(both, sizes)
    return 100 * both >= percent * (sizes[:, None] + sizes[None] - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, digest (of the set), sketch (the signature's bytes) for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "key", "n_shingles", "digest", "sketch"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return texts.mapInArrow(lean("near_dedup", run), "doc_id long, key long, n_shingles long, digest binary, sketch binary")


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _prefixed(nodes: DataFrame, depth: int, trees: int) -> DataFrame:
    """node, region: the prefix that a node has in each tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                regions = prefixes(_matrix(own.column(1)), depth, trees).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.column(0).to_numpy(), trees)), pa.array(regions)], names=["node", "region"])

    return nodes.select("node", "sketch").mapInArrow(lean("near_dedup", run), "node long, region long")


def _if_few(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast where it has MAX_BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _few_of(df: DataFrame) -> tuple[DataFrame, bool]:
    """A checkpointed table, held by the driver and to be broadcast where it has MAX_BROADCAST_ROWS rows at most; whether it has any."""
    table = on_driver(df, MAX_BROADCAST_ROWS)
    return (df, True) if table is None else (F.broadcast(df.sparkSession.createDataFrame(table)) if table.num_rows else df, table.num_rows > 0)


def _blocks(size: Column, limit: int) -> Column:
    """How many blocks of about half of the limit."""
    return F.greatest(F.ceil(size / max(1, limit // 2)), F.lit(1)).cast("long")


def _own(blocks: Column) -> Column:
    """The block of a node, from 0."""
    return F.pmod(F.xxhash64("node"), blocks)


def _upto(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))


def _parts(beyond: DataFrame, region_nodes: int) -> DataFrame:
    """node, region: each node's largest region, cut into parts; the region's first node is in all of them."""
    mine = beyond.groupBy("node").agg(F.max(F.struct("n", "region")).alias("m")).select("node", "m.region", "m.n")
    blocks = _blocks(F.col("n"), region_nodes)
    parts = mine.select("node", F.xxhash64("region", _own(blocks)).alias("region"))
    firsts = mine.groupBy("region", "n").agg(F.min("node").alias("node")).select("node", "region", _upto(blocks).alias("i"))
    return parts.unionAll(firsts.select("node", F.xxhash64("region", "i").alias("region"))).distinct()


def _block_pairs(members: DataFrame, blocks: Column) -> DataFrame:
    """node, region: a region for each pair of different blocks of a region's nodes."""
    spread = members.select("node", "region", _own(blocks).alias("own"), _upto(blocks).alias("other")).where("own <> other")
    return spread.select("node", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"))


def _rows_with_all(region_nodes: int) -> Column:
    """How many rows _rest_with_all makes of a region."""
    main, rest = F.col("n") - F.col("rest"), F.col("rest")
    return main * _blocks(rest, region_nodes) + rest * (_blocks(main, region_nodes) + _blocks(rest, region_nodes))


def _rest_with_all(mixed: DataFrame, region_nodes: int) -> DataFrame:
    """node, region: blocks of a region's rest with blocks of its main component, and with each other; mixed(node, region, main, n, rest)."""
    own = mixed.select("node", "region", "main", _blocks(F.col("n") - F.col("rest"), region_nodes).alias("mb"), _blocks(F.col("rest"), region_nodes).alias("rb"))
    main = own.where("main").select("node", "region", _own(F.col("mb")).alias("j"), _upto(F.col("rb")).alias("i"))
    rest = own.where("not main").withColumn("i", _own(F.col("rb")))
    across = main.select("node", "region", "i", "j").unionAll(rest.select("node", "region", "i", _upto(F.col("mb")).alias("j")))
    among = rest.select("node", "region", "i", "rb", _upto(F.col("rb")).alias("j")).where("i <> j or rb = 1")
    return across.select("node", F.xxhash64("region", "i", "j").alias("region")).unionAll(among.select("node", F.xxhash64("region", F.lit("rest"), F.least("i", "j"), F.greatest("i", "j")).alias("region")))


def _mixed(beyond: DataFrame, components: DataFrame) -> DataFrame:
    """node, region, n, main, rest: the regions of beyond that hold more than one component, which nodes belong to the largest, and how many don't."""
    placed = beyond.join(components, "node", "left").select("node", "region", "n", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("region", "n", "component").agg(F.count("*").alias("c"))
    largest = counts.groupBy("region", "n").agg(F.max(F.struct("c", "component")).alias("m"))
    several = checkpoint(largest.select("region", F.col("m.component").alias("largest"), (F.col("n") - F.col("m.c")).alias("rest")).where("rest > 0"))
    return placed.join(_if_few(several), "region").select("node", "region", "n", (F.col("component") == F.col("largest")).alias("main"), "rest")


def _low_bytes(nodes: DataFrame) -> DataFrame:
    """nodes with the low byte of each value of their signature for a sketch: enough to tell how many agree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _matrix(batch.column(1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in low], pa.binary()), batch.column(2)], names=["node", "sketch", "n_shingles"])

    return nodes.select("node", "sketch", "n_shingles").mapInArrow(lean("near_dedup", run), "node long, sketch binary, n_shingles long")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by their first column; they come sorted by it. A node stands once in a group."""
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, rows in groupby(stream, key=lambda r: r[0]):
        yield key, list({r[1]: r for r in rows}.values())


def candidates(regions: DataFrame, nodes: DataFrame, components: DataFrame | None = None, lenient: float = LENIENT) -> DataFrame:
    """node, region, weight (the node's shingles): what hangs together by signatures in each region; equal groups of different trees are one.

    nodes(node, sketch, n_shingles) have signatures; likeness within one of components(node, component) doesn't count, as it is known.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, region, weight, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, region, weight)], names=["node", "region", "weight"])

        for _, rows in _groups(batches):
            rows.sort(key=lambda r: r[1])
            ids, sizes, component = (np.array([r[k] for r in rows], np.int64) for k in (1, 3, 4))
            if (component == component[0]).all():
                continue
            similar = _similar(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), lenient)
            label = labels_of(similar & (component[:, None] != component[None]))
            for i in np.flatnonzero(np.bincount(label, minlength=len(label)) > 1):
                own = ids[at := label == i]
                node.append(own)
                region.append(np.full(len(own), np.uint64(xxhash.xxh3_64_intdigest(own.tobytes()))).view(np.int64))
                weight.append(sizes[at])
                n += len(own)
            if n > 50_000:
                yield out()
                node, region, weight, n = [], [], [], 0
        if node:
            yield out()

    low = _low_bytes(nodes)
    low = low.withColumn("component", F.col("node")) if components is None else low.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = low.join(regions, "node").select("region", "node", "sketch", "n_shingles", "component")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(lean("near_dedup", run), "node long, region long, weight long").distinct()


def _merged_here(node: np.ndarray, region: np.ndarray, weight: np.ndarray, group_nodes: int, group_shingles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merged() of a few rows, on the driver."""
    names, group = np.unique(region, return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, group, node)
    nodes, roots = components_of(least[group], node)
    _, at, row = np.unique(node, return_index=True, return_inverse=True)
    weights, whole = weight[at], np.unique(roots, return_inverse=True)[1]
    n, w, r = np.bincount(whole), np.bincount(whole, weights).astype(np.int64), np.bincount(whole[row])
    blocks = np.maximum(-(-n // max(1, group_nodes // 2)), -(-w // max(1, group_shingles // 2)))
    blocks[(n <= group_nodes) & (w <= group_shingles)] = 1
    blocks[(blocks > 1) & (n * (blocks - 1) >= r)] = 0
    raw, one = blocks[whole[row]] == 0, blocks[whole] == 1
    out = [(node[raw], region[raw], weight[raw]), (nodes[one], _mix(roots[one].astype(np.uint64) * BASE + np.uint64(1)).view(np.int64), weights[one])]
    order, ends = np.argsort(whole, kind="stable"), np.cumsum(n)
    for k in np.flatnonzero(blocks > 1):
        own = order[ends[k] - n[k] : ends[k]]
        share = np.cumsum(weights[own] if w[k] * group_nodes > n[k] * group_shingles else np.ones(n[k], np.int64))
        block = np.minimum(share * blocks[k] // share[-1], blocks[k] - 1)
        for i, j in combinations(range(blocks[k]), 2):
            pair = own[(block == i) | (block == j)]
            name = np.uint64(xxhash.xxh3_64_intdigest(f"{roots[own[0]]} {i} {j}"))
            out.append((nodes[pair], np.full(len(pair), name).view(np.int64), weights[pair]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def merged(groups: DataFrame, group_nodes: int = REGION_NODES, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """groups, where those that share nodes are one as long as they are within the limits together: most nodes' sets then go to one place.

    What is beyond the limits is cut into pairs of blocks, or left as it is where that makes fewer rows (a chain of many groups).
    """
    firsts = groups.groupBy("region").agg(F.min("node").alias("a"))
    whole = connected_components(groups.join(firsts, "region").select("a", F.col("node").alias("b")))
    placed = checkpoint(groups.join(whole, "node").select("node", "region", "weight", "component"))
    nodes = placed.groupBy("component", "node").agg(F.max("weight").alias("weight"), F.count("*").alias("r"))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum("r").alias("r"))
    cut = F.greatest(_blocks(F.col("n"), group_nodes), _blocks(F.col("w"), group_shingles))
    blocks = F.when((F.col("n") <= group_nodes) & (F.col("w") <= group_shingles), 1).when(F.col("n") * (cut - 1) < F.col("r"), cut).otherwise(0)
    blocks = _if_few(checkpoint(sizes.select("component", blocks.cast("long").alias("blocks"))))
    raw = placed.join(blocks.where("blocks = 0"), "component", "left_semi").select("node", "region", "weight")
    spread = nodes.join(blocks.where("blocks > 0"), "component").select("component", "node", "weight", "blocks", _own(F.col("blocks")).alias("own"), _upto(F.col("blocks")).alias("other"))
    pairs = spread.where("blocks = 1 or own <> other")
    return raw.unionAll(pairs.select("node", F.xxhash64("component", F.lit("merged"), F.least("own", "other"), F.greatest("own", "other")).alias("region"), "weight"))


def confirmed_links(groups: DataFrame, firsts: DataFrame, docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", group_shingles: int = GROUP_SHINGLES, light: bool = False) -> DataFrame:
    """a, b: links that join all of a group's nodes whose full sets are linked, directly or by others of the group.

    groups(node, region, weight) is of candidates; firsts(node, first, digest) says where a node's text is. Groups above group_shingles are compared in pairs of blocks;
    light: there are none, and groups are few rows that the driver holds.
    """

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            sets = [(n, s.tobytes()) for n, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _digest(s := shingles(t)) == d]  # rows may share a doc_id
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["node", "shingles"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            label = labels_of(linked_exactly([np.frombuffer(r[2], np.uint64) for r in rows], percent))
            ids = np.array([r[1] for r in rows], np.int64)
            far = np.flatnonzero(label != np.arange(len(label)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

    if light:
        groups = F.broadcast(groups)
        wanted = F.broadcast(firsts.join(groups, "node", "left_semi").select("node", "first", "digest"))
    else:
        heavy = checkpoint(groups.groupBy("region").agg(F.sum("weight").alias("w")).where(F.col("w") > group_shingles))
        if not heavy.isEmpty():
            few = _if_few(heavy)
            groups = groups.join(few, "region", "left_anti").select("node", "region").unionAll(_block_pairs(groups.join(few, "region"), _blocks(F.col("w"), group_shingles)))
        groups = _if_few(checkpoint(groups))
        wanted = _if_few(checkpoint(firsts.join(groups.select("node").distinct(), "node", "left_semi").select("node", "first", "digest")))
    texts = docs.select(F.col(id_col).cast("long").alias("first"), F.col(text_col).alias("text"))
    sets = texts.join(wanted, "first").select("node", "digest", "text").mapInArrow(lean("near_dedup", to_sets), "node long, shingles binary")
    rows = sets.join(groups, "node").select("region", "node", "shingles")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(lean("near_dedup", run), "a long, b long")


def _components(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, percent: int, region_nodes: int, id_col: str, text_col: str) -> DataFrame:
    """node, component of the nodes that are linked: the forest, depth by depth."""
    components: DataFrame | None = None
    left, waiting = nodes, None  # nodes that go on, and regions that wait for the next comparison

    def compare(regions: DataFrame, few: bool = False) -> None:
        nonlocal components
        regions = _if_few(checkpoint(regions)) if few else regions
        groups = checkpoint(candidates(regions, nodes, components))
        table = on_driver(groups, MAX_BROADCAST_ROWS)
        if table is not None and not table.num_rows:
            components = nodes.select("node", F.col("node").alias("component")).where("false") if components is None else components
            return
        if table is None:
            groups, light = checkpoint(merged(groups, region_nodes)), False
        else:
            node, region, weight = _merged_here(*(table[c].to_numpy() for c in ("node", "region", "weight")), region_nodes, GROUP_SHINGLES)
            groups = nodes.sparkSession.createDataFrame(pa.table({"node": node, "region": region, "weight": weight}))
            light = len(node) <= MAX_BROADCAST_ROWS and np.bincount(np.unique(region, return_inverse=True)[1], weight).max() <= 1.1 * GROUP_SHINGLES
        found = confirmed_links(groups, firsts, docs, percent, id_col, text_col, light=light)
        stars = None if components is None else components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = connected_components(found if stars is None else found.unionAll(stars))

    for i, (depth, trees) in enumerate(LEVELS):
        keyed = _prefixed(left, depth, trees)
        sizes = checkpoint(keyed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"))
        large, some = _few_of(sizes.where(F.col("n") > region_nodes))
        rest = keyed.join(large, "region", "left_anti") if some else keyed  # so that the rows of a hot region don't meet in one task
        regions = rest.join(sizes.where(F.col("n") <= region_nodes).select("region"), "region", "left_semi").select("node", "region")
        regions = regions if waiting is None else regions.unionAll(waiting)
        if not some:
            compare(regions)
            return components
        beyond = checkpoint(keyed.join(large, "region").select("node", "region", "n"))
        compare(_parts(beyond, region_nodes), few=True)  # first, so that what one cluster holds isn't compared again
        compare(regions)
        mixed = checkpoint(_mixed(beyond, components))
        now = F.lit(True) if i + 1 == len(LEVELS) else _rows_with_all(region_nodes) <= ROWS_WITH_ALL * F.col("n")
        waiting = _rest_with_all(mixed.where(now), region_nodes)
        deeper, some = _few_of(checkpoint(mixed.where(~now).select("node").distinct()))
        if not some:
            break
        left = checkpoint(nodes.join(deeper, "node", "left_semi"))
    compare(waiting, few=True)
    return components


def near_duplicates(docs: DataFrame, percent: int = PERCENT, region_nodes: int = REGION_NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reached by links), kept (doc_id = component_id), key (a hash of the text) and cluster (a number for each component) for each row of docs.

    Texts without words have no shingles, no links and no cluster. Rows repeat as they do in docs; rows that share a doc_id and differ in
    their sets are linked each for itself. A null doc_id is a component of its own with component_id and cluster null and kept true. Other columns are not read.
    """
    base = checkpoint(fingerprints(docs, id_col, text_col))
    filled = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = filled.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    # numbers that the checkpoint fixes: a recomputed task can't change them
    sets = checkpoint(sets.withColumn("node", F.monotonically_increasing_id()))
    firsts, nodes = sets.select("digest", "first", "node"), sets.select("node", "sketch", "n_shingles")
    components = _components(nodes, firsts, docs, percent, region_nodes, id_col, text_col)
    ends = firsts.select("node", "first").join(components, "node")
    least = ends.groupBy("component").agg(F.min("first").alias("least"))
    placed = firsts.join(ends.select("node", "component").join(least, "component"), "node", "left")
    of_digest = placed.select("digest", F.coalesce("component", "node").alias("cluster"), F.coalesce("least", "first").alias("least"))
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
    joined = base.select("doc_id", "key", "n_shingles", linked).join(of_digest, "digest", "left")
    component = F.coalesce("least", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "key", "cluster")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE_SQL = {"op3_near_dedup": ORACLE}
