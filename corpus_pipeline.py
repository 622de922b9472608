"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and returns a DataFrame; all but the
last return the columns of docs. run() writes what each stage returns to the checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bpe_codec import bpe_encode, build_lexicon
from docloom.llm.common import checkpoint, fresh, read_table
from docloom.llm.decontamination import decontaminate
from docloom.llm.language_id import identify_documents, keep_accepted
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.pii import replace_entities

MAX_BROADCAST_ROWS = 500_000
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return keep_accepted(docs, identify_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id; of rows that share it, and of equal rows, one."""
    doc, key, cluster, place = fresh(docs, "_doc", "_key", "_cluster", "_place")
    found = checkpoint(near_duplicates(docs).select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("cluster").alias(cluster), "kept"))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(key))
    gone = found.where(~F.col("kept")).select(doc, key).distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone, same, "left_anti")
    again = found.where(F.col("kept") & F.col(doc).isNotNull()).groupBy(doc, F.coalesce(cluster, key).alias(cluster)).agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n > 1")
    again = checkpoint(again.select(doc, cluster, key))
    if again.isEmpty():
        return kept
    rows = found.where("kept").select(doc, key, F.coalesce(cluster, key).alias(cluster)).distinct().join(again.select(doc, cluster), [doc, cluster], "left_semi")
    firsts = again.select(doc, key)
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(c for c, t in docs.dtypes if not t.startswith("map")))
    one = kept.join(firsts, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return kept.join(rows.select(doc, key), same, "left_anti").unionAll(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars, where there is one, follows the text."""
    (n,) = fresh(docs, "_n_entities")
    replaced = replace_entities(docs, count_col=n)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(n) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        replaced = replaced.withColumn("n_chars", n_chars)
    return replaced.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, and decoded_md5, the digest of the text that the ids decode to."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    coded = bpe_encode(docs, path, build_lexicon(docs, path), decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: SQL can't express the trigram model of the first stage, the keyed surrogates or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
