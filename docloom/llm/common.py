"""Small helpers shared by the operators: reading tables, checkpoints, batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Runs of characters that separate words: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of text that a Python worker holds as words at a time.
PIECE_CHARS = 1_000_000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Caches of Python workers, and the operators that use each.
_CACHES: dict[Callable, tuple[str, ...]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; where it is unset, take a temporary folder on one machine (tests), and refuse on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    place = context.getConf().get("spark.checkpoint.dir")
    if not place and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(place or tempfile.mkdtemp(prefix="docloom-"))


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned in here leaves no shuffle files once it has run; otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: lost executors cost no recomputation, and the shuffle files behind it go."""
    ensure_checkpoint_dir(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, so that df itself keeps its shuffle files


def on_driver(df: DataFrame, most: int) -> pa.Table | None:
    """The rows of a checkpointed table, or None where it has more than `most`."""
    with passing_shuffles(df.sparkSession):
        return df.select("*").toArrow() if df.count() <= most else None


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words as array<string>: runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def cached(*operators: str, size: int = 1) -> Callable[[Callable], Callable]:
    """lru_cache for what Python workers keep from one task to the next, for these operators alone: see lean()."""

    def wrap(f: Callable) -> Callable:
        kept = lru_cache(maxsize=size)(f)
        _CACHES[kept] = operators
        return kept

    return wrap


def lean(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in workers that serve one operator after another: caches of the others go before it, and freed memory goes back to the system after it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cache, operators in _CACHES.items():
            if operator not in operators and cache.cache_info().currsize:
                cache.cache_clear()
                gc.collect()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
