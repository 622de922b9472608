"""Benchmark decontamination: a broadcast hash set of test n-grams meets all token windows of the corpus.

A bitmap of the first LEAD words of all benchmark windows, a literal of the plan, is asked at each word of a document; only the windows
that begin at the places it lets through become rows. Their hashes meet the benchmark's windows in a broadcast join, and
a hit is verified word by word in the same step. The broadcast side is cut into blocks of at most MAX_BROADCAST_WINDOWS windows and
MAX_BROADCAST_BYTES bytes; a larger benchmark takes a scan for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import SEPARATORS, alnum_words, checkpoint, fresh, read_table

WINDOW = 10
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_BROADCAST_BYTES = 256_000_000
#: Words of a window that the bitmap knows, and its bits for each of them.
LEAD = 4
BITS = 16


def _bitmap(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A literal array<bigint> with a bit for each of the n hashes, and how many numbers it has: a power of two."""
    numbers = 1 << max(4, (n * BITS // 64).bit_length())
    bits = hashes.select(F.pmod(F.shiftright("hash", 6), F.lit(numbers)).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    found = {r["at"]: r["bits"] for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}  # at most `numbers` rows: two bytes a window
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(numbers))), ",").cast("array<bigint>"), numbers


def _starts(words: Column, size: int, bitmap: Column, numbers: int) -> Column:
    """The places where `size` words stand that the bitmap lets through."""
    n = F.size(words)

    def known(i: Column) -> Column:
        hash = F.xxhash64(F.slice(words, i + 1, size))
        return F.getbit(F.get(bitmap, F.pmod(F.shiftright(hash, 6), F.lit(numbers)).cast("int")), hash.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.when(n >= size, F.filter(F.sequence(F.lit(0), n - size), known)).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, starts: Column, size: int) -> Column:
    """array<struct<start, window>> of the windows of so many words at these places."""
    whole = F.filter(starts, lambda i: i + size <= F.size(words))
    return F.transform(whole, lambda i: F.struct(i.alias("start"), F.slice(words, i + 1, size).alias("window")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, gram array<string>, items array<string>: the distinct windows and the items that hold each.

    An item of fewer words than a window, but not none, is one window; null and empty items have none. A null id counts as the empty one.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), alnum_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    grams = items.select("item", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("hash"), "gram", "items")


def hits_of(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS, bench_id_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans array<struct<start, size>>, items array<string>, copies, and key (a hash of the text) for each distinct row of docs.

    spans are the places of benchmark windows by word, in order; copies counts rows with this doc_id and text.
    Null texts have no words and no hits.
    """
    grams = checkpoint(benchmark_windows(benchmark, window, bench_id_col, bench_text_col))
    size_of = F.octet_length(F.array_join("gram", " ")) + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    found = grams.agg(F.count("*").alias("n"), F.collect_set(F.size("gram")).alias("sizes"), F.sum(size_of).alias("bytes")).first()
    blocks = max(1, -(-found.n // max_broadcast), -(-(found.bytes or 0) // MAX_BROADCAST_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), alnum_words(F.col(text_col)).alias("words"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    head = F.array(F.struct(F.lit(-1).alias("start"), F.array().cast("array<string>").alias("window")))  # stands for the row itself
    parts = []
    for block in range(blocks):
        own = grams if blocks == 1 else grams.where(F.pmod(F.col("hash"), F.lit(blocks)) == block)
        windows = []
        for lead in sorted({min(s, LEAD) for s in found.sizes}):
            leads = own.where(F.least(F.size("gram"), F.lit(LEAD)) == lead).select(F.xxhash64(F.slice("gram", 1, lead)).alias("hash"))
            starts = _starts(F.col("words"), lead, *_bitmap(leads, found.n // blocks))
            windows += [_windows(F.col("words"), starts, s) for s in sorted(found.sizes) if min(s, LEAD) == lead]
        # an outer generator, which no filter on the size of its array is derived from (it would make the words anew for each place); rows carry their own window and not the text's words
        rows = base.withColumn("found", F.concat(head, *windows)).select("doc_id", "key", "n_words", F.inline_outer("found").alias("start", "window"))
        rows = rows.withColumn("hash", F.xxhash64("window")).withColumn("size", F.size("window"))
        own = F.broadcast(own.select(F.col("hash").alias("_hash"), "gram", "items"))
        joined = rows.join(own, (F.col("hash") == F.col("_hash")) & (F.col("start") >= 0) & (F.col("window") == F.col("gram")), "left")
        keep = F.col("_hash").isNotNull() | (F.col("start") < 0) if block == 0 else F.col("_hash").isNotNull()
        parts.append(joined.where(keep).select("doc_id", "key", "n_words", "start", "size", "items"))
    hits = reduce(DataFrame.unionAll, parts)
    place = F.when(F.col("start") >= 0, F.struct("start", "size"))
    grouped = hits.groupBy("doc_id", "key", "n_words").agg(F.array_sort(F.collect_set(place)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count(F.when(F.col("start") < 0, 1)).alias("copies"))
    return grouped


def covered(spans: Column) -> Column:
    """How many words sorted spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for each row of docs; rows repeat as they do in docs.

    Without benchmark windows, words or text n_hit is 0 and items is empty. Other columns are not read.
    """
    hits = hits_of(docs, benchmark, window, id_col, text_col, max_broadcast)
    counted = hits.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("copies").cast("int").alias("copies"))
    return counted.select("doc_id", "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """docs with all its columns, without contaminated documents (mode "documents") or with the hit words and the separators after them cut out of the text (mode "spans")."""
    doc, key, spans = fresh(docs, "_doc", "_key", "_spans")
    hits = hits_of(docs, benchmark, window, id_col, text_col, max_broadcast).where(F.size("spans") > 0).select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("spans").alias(spans))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(key))
    if mode == "documents":
        return docs.join(hits, same, "left_anti")
    words = F.split(F.col(text_col), SEPARATORS)
    gaps = F.split(F.col(text_col), SEPARATORS.replace("[", "[^", 1))
    # an empty first word means that the text begins with a gap; a gap before the first word is kept
    lead = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)
    within = lambda i: F.exists(spans, lambda s: (i - lead >= s["start"]) & (i - lead < s["start"] + s["size"]))
    text = F.array_join(F.transform(words, lambda w, i: F.when(within(i), "").otherwise(F.concat(w, F.coalesce(F.get(gaps, i + 1 - lead), F.lit(""))))), "")
    columns = [F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return docs.join(hits, same, "left").select(*columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words and benchmark items each document shares."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, len(g) AS size, g FROM (SELECT item, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: w[i : i + least(len(w), {WINDOW}) - 1])) AS g FROM b WHERE len(w) > 0)),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size),
hits AS (SELECT r, s, x.size, item FROM (SELECT r, s, size, w[s : s + size - 1] AS g FROM starts) x JOIN grams ON x.g = grams.g),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)"""

QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL = {"op4_decontamination": ORACLE}
