"""Exact top-k search by inner product: a Voronoi kNN join.

Rows fall into the cells of pivots. A cell's summary is its pivot, its count and its radius r, so a
query q meets scores in [q.p - |q| r, q.p + |q| r] there. The counts of the cells with the best lower ends
give each query a score that k rows, beside those of its own vec_id, surely reach; the query is sent to just those cells whose upper end
reaches it. Cells of many rows are dealt out in chunks, each solved locally, and the best k of all chunks remain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import read_table

CELL_ROWS = 2_000
MAX_PIVOTS = 1_024
CHUNK_ROWS = 20_000
QUERY_BLOCK = 256


def scaled_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector array<double> of floor(scale * x); vectors null or holding null or non-finite components, and null ids, are left out."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(whole)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vector"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    rows = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products as int64: by doubles where these are exact."""
    most = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(data).max(initial=0)) * max(1, data.shape[1])
    return (queries @ data.T).astype(np.int64) if most < 2**53 else queries.astype(np.int64) @ data.astype(np.int64).T


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of data with the highest inner products for each row of queries, ties to the smaller vec_id.

    Both have (vec_id long, vector array<double> of whole numbers). A row isn't found for a query of its own vec_id; queries alike
    in id and vector count once; rows of data that repeat are found as often. Shorter vectors count as if they ended
    in zeros. With fewer than k other rows, all are returned; without rows or queries, nothing is.
    """
    spark = data.sparkSession
    n, width = data.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("vector"))).first()[0] or 0)
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MAX_PIVOTS, max(1, n // cell_rows))).collect()  # MAX_PIVOTS rows at most
    pivots = np.zeros((max(1, len(chosen)), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r.vector)] = r.vector
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            far = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T))
            cell = far.argmin(1)
            # from the difference itself, as the expanded form loses digits
            dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(dist)], names=["vec_id", "vector", "cell", "dist"])

    placed = data.select("vec_id", "vector").mapInArrow(assign, "vec_id long, vector array<double>, cell long, dist double")
    summary = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # a row for each pivot
    cells = sorted(summary)
    about = spark.sparkContext.broadcast((np.array(cells, np.int64), np.array([summary[c][0] for c in cells], np.int64), np.array([summary[c][1] for c in cells])))
    chunks = {c: -(-summary[c][0] // chunk_rows) for c in cells}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_id, vector, cells: where the query has to look."""
        number, count, radius = about.value
        for batch in batches:
            q = _matrix(batch.column(1), width)
            middle, reach = q @ shared.value[number].T, np.sqrt((q**2).sum(1))[:, None] * radius[None]
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            low, high = middle - reach - slack, middle + reach + slack
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(count[order], axis=1) >= k + batch.column(2).to_numpy()[:, None]  # some may be rows of the query's own vec_id
            at = np.where(enough.any(1), enough.argmax(1), -1)
            sure = np.where(at >= 0, np.take_along_axis(low, order, 1)[np.arange(len(q)), at], -np.inf)
            needed = [number[row].tolist() for row in high >= sure[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(needed, pa.list_(pa.int64()))], names=["query_id", "vector", "cells"])

    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = F.create_map(*(F.lit(x) for c in cells for x in (c, chunks[c])))
    salted = placed.select(F.struct("cell", F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("cell")).cast("long")).alias("chunk")).alias("place"), "vec_id", "vector")
    asked = queries.select("vec_id", "vector").distinct()
    barred_rows = data.select("vec_id").join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(barred_rows, "vec_id", "left").select("vec_id", "vector", F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    sent = asked.mapInArrow(send, "query_id long, vector array<double>, cells array<long>")
    sent = sent.select("query_id", "vector", F.explode("cells").alias("cell"))
    sent = sent.select("query_id", "vector", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(parts, F.col("cell")).cast("long") - 1)).alias("chunk"))
    sent = sent.select(F.struct("cell", "chunk").alias("place"), "query_id", "vector")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        ids, data = right.column("vec_id").to_numpy(), _matrix(right.column("vector"), width)
        query_ids, vectors = left.column("query_id").to_numpy(), left.column("vector").combine_chunks()
        out: list[list] = [[], [], [], []]
        for i in range(0, len(query_ids) if len(ids) else 0, QUERY_BLOCK):
            own, raw = query_ids[i : i + QUERY_BLOCK], vectors.slice(i, QUERY_BLOCK)
            scores = _scores(_matrix(raw, width), data)
            barred = own[:, None] == ids[None]
            scores[barred] = np.iinfo(np.int64).min
            edge = -np.partition(-np.maximum(scores, np.iinfo(np.int64).min + 1), min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            row, col = np.nonzero((scores >= edge[:, None]) & ~barred)
            order = np.lexsort((col, -scores[row, col], row))
            row, col = row[order], col[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[best], col[best]
            vector = raw.take(pa.array(row))
            out[0].append(pa.array(own[row]))
            out[1].append(vector)
            out[2].append(pa.array(ids[col]))
            out[3].append(pa.array(scores[row, col]))
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()]
        return pa.table([pa.chunked_array([c.cast(t) for c in x], t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vector", "vec_id", "score"])

    found = sent.groupBy("place").cogroup(salted.groupBy("place")).applyInArrow(solve, "query_id long, vector array<double>, vec_id long, score long")
    found = found.withColumn("_query", F.xxhash64("vector")).drop("vector")
    rank = F.row_number().over(Window.partitionBy("query_id", "_query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each row whose vec_id is divisible by 50."""
    rows = scaled_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id) AS rank
FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id) WHERE rank <= 5"""

QUERIES = {"op6_topk_search": op6_topk_search}
ORACLE_SQL = {"op6_topk_search": ORACLE}
