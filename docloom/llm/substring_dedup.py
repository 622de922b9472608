"""Substring dedup: Rabin-Karp hashes of all windows of 20 words, counted in Spark.

Documents are taken in blocks, ranges of doc_id of about BLOCK_BYTES of text. Each block's distinct
window hashes go to hash buckets, packed as arrays; a bucket finds the hashes that more than one block
holds and tells all of these blocks but the first. A block then knows, for each of its windows, whether the same
words start earlier: in an earlier block (told), or in the block itself (seen there). Covered words
merge into maximal intervals, which are removed. What a bucket or block holds follows BLOCK_BYTES and
BUCKET_WINDOWS and not the number of copies: a passage in every document is one hash of each block.

Windows are compared by a 64-bit hash: among n windows about n^2 / 2^65 pairs of different ones
meet by chance (0.0005 for the 135 million windows of half a GB).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import read_table, text_batches

WINDOW = 20
BLOCK_BYTES = 8_000_000
BUCKET_WINDOWS = 400_000
FLUSH_WORDS = 1_500_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, text string"


def words_of(text: str | None) -> list[bytes]:
    """Words between runs of ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


def window_hashes(texts: list[list[bytes]], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows in the texts laid end to end: hash, and the place of the first word. Windows across texts are left out.

    The hash of words w[i] is the sum of w[i] * BASE^(size - i) modulo 2^64, from differences of one running sum.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in texts for w in t), np.uint64, total)
    up = np.cumprod(np.full(total + 1, BASE, np.uint64))
    down = np.cumprod(np.full(total, INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * down)])
    hashes = (sums[size:] - sums[:-size]) * up[size - 1 : -1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    ends = np.repeat(np.cumsum(lengths), lengths)[: total - size + 1]
    starts = np.flatnonzero(np.arange(total - size + 1) + size <= ends)
    return hashes[starts], starts


def repeated_in(hashes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Whether each hash is in `earlier` or stands before in `hashes`."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    if len(earlier):
        earlier = np.sort(earlier)
        at = np.minimum(np.searchsorted(earlier, hashes), len(earlier) - 1)
        again |= earlier[at] == hashes
    return again


def _blocks(docs: DataFrame, key: Column, blocks: int) -> Column:
    """The number of the range of ids that key falls in: numbers rise with the id.

    Up to 1024 ranges are quantiles, found in two steps of comparisons; more are even parts of these.
    """
    n = min(blocks, 1024)
    low, high = (int(x or 0) for x in docs.agg(F.min(key), F.max(key)).first())
    bounds = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20_000)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    first = count(longs(coarse))
    number = (F.greatest(first - 1, F.lit(0)) * step + F.when(first > 0, count(F.get(F.array(*map(longs, fine)), first - 1))).otherwise(0)).cast("long") if bounds else F.lit(0).cast("long")
    parts = -(-blocks // n)
    if parts == 1:
        return number
    edges = longs([low, *bounds, high + 1])
    inside = (key - F.get(edges, number.cast("int"))).cast("double") / (F.get(edges, number.cast("int") + 1) - F.get(edges, number.cast("int"))).cast("double")
    return number * parts + F.least(F.floor(inside * parts), F.lit(parts - 1))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal intervals of removed words), text (kept words, one space between) for each row of docs.

    A word goes if it is in a window whose words also start earlier: in a smaller doc_id or earlier in the same
    document. Windows are judged on the input. Rows that share a doc_id are taken in the order of their texts, null
    ids before all others. Null and empty texts have no words. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-n_bytes // (6 * bucket_windows)))
    rows = rows.withColumn("block", _blocks(rows.select("doc_id"), F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")), max(1, -(-n_bytes // block_bytes))))

    def announce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, block, hashes: the distinct window hashes of each block's part of the input."""
        held: dict[int, list[list[bytes]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, texts in held.items():
                hashes = np.unique(window_hashes(texts, window)[0])
                to = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                hashes, to = hashes[order], to[order]
                present, first = np.unique(to, return_index=True)
                parts = [p.tobytes() for p in np.split(hashes, first[1:])] if len(to) else []
                yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int64)), pa.array(np.full(len(present), block, np.int64)), pa.array(parts, pa.binary())], names=["bucket", "block", "hashes"])
            held.clear()

        n = 0
        for batch in text_batches(batches):
            for text, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) >= window:
                    held.setdefault(block, []).append(words)
                    n += len(words)
            if n > FLUSH_WORDS:
                yield from flush()
                n = 0
        yield from flush()

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, hashes: those that an earlier block holds too. Rows come sorted by bucket."""
        stream = ((k, b, h) for batch in batches for k, b, h in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(stream, key=lambda r: r[0]):
            group = sorted(((b, h) for _, b, h in group), key=lambda r: r[0])
            hashes = np.frombuffer(b"".join(h for _, h in group), np.uint64)
            blocks = np.repeat(np.array([b for b, _ in group], np.int64), [len(h) // 8 for _, h in group])
            order = np.argsort(hashes, kind="stable")
            hashes, blocks = hashes[order], blocks[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            owner = blocks[np.flatnonzero(first)][np.cumsum(first) - 1]
            late = owner != blocks
            hashes, blocks = hashes[late], blocks[late]
            order = np.argsort(blocks, kind="stable")
            hashes, blocks = hashes[order], blocks[order]
            present, at = np.unique(blocks, return_index=True)
            if len(present):
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array([p.tobytes() for p in np.split(hashes, at[1:])], pa.binary())], names=["block", "hashes"])

    def cut(block: pa.Table, told: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        texts = [words_of(t) for t in block.column("text").to_pylist()]
        hashes, starts = window_hashes(texts, window)
        earlier = np.frombuffer(b"".join(told.column("hashes").to_pylist()), np.uint64)
        bad = starts[repeated_in(hashes, earlier)]
        total = sum(map(len, texts))
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        at, kept, spans, removed = 0, [], [], []
        for words in texts:
            own = gone[at : at + len(words)]
            at += len(words)
            removed.append(int(own.sum()))
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in turns.reshape(-1, 2)])
            kept.append(b" ".join(compress(words, (~own).tolist()) if removed[-1] else words).decode())
        return pa.table([block.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "text"])

    found = rows.mapInArrow(announce, "bucket long, block long, hashes binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tell, "block long, hashes binary")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, SCHEMA)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated passages are cut out."""
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
bad AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM starts) WHERE r > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM bad) GROUP BY doc_id),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t FROM words ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {"op2_substring_dedup": ORACLE}
