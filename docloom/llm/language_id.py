"""Language ID by Bayesian evidence fusion.

The posterior of a document's language is the product of
- the text's likelihood under character trigram models (tempered, as trigrams of a text depend on each other),
- the likelihood of the language that its markup declares, from how often texts of each language declare it,
- a prior of its host, smoothed to that of its address suffix, and this to that of the corpus.
Counts for the last two come from grouped aggregation over all documents of the languages that their texts alone suggest.

Where the declared language also labels the training rows, the models are two, each fitted on one half of the rows by a hash of
the id, and a document is judged by the model that its own half took no part in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, fresh, lean, read_table, text_batches

#: Bound on the labelled rows of each language that the text model is fitted on.
TRAIN_ROWS = 2_000
#: The most frequent labels that are languages; rows with others are not trained on.
MAX_LANGUAGES = 200
CODES = 1 << 16
TEMPER = 0.05
SMOOTH = 20.0
MIN_CONFIDENCE = 0.5
MAX_BROADCAST_ROWS = 500_000


class TextModel(NamedTuple):
    """Log-probabilities by half of the rows judged (1 or 2 of them), language and trigram code."""

    languages: list[str]
    table: np.ndarray


def trigram_codes(text: str | None) -> np.ndarray:
    """A code below CODES for each trigram of letters and spaces of the text's UTF-8, in lower case; the rest is space, and runs of space are one."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    letter = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
    raw = np.where(letter, raw, 32).astype(np.int64)
    raw = raw[np.concatenate([[True], letter[1:] | letter[:-1]])]
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (raw[:-2] * 40_503 ^ raw[1:-1] * 2_531 ^ raw[2:] * 151) % CODES


def primary_subtag(tag: Column) -> Column:
    """The language of a tag such as en-GB: two or three letters; anything else is the empty string."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(tag, F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


def half_of(id: Column) -> Column:
    """0 or 1 for a row's id."""
    return F.pmod(F.xxhash64(id, F.lit("half")), F.lit(2)).cast("int")


def train_text_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS, halves: bool = False) -> TextModel:
    """Trigram models of the labels (primary subtags) of labelled, from about `rows` rows of each at most, chosen by a hash of the id.

    With halves, the model at place h of the table is fitted on the rows whose half is not h.
    """
    tagged = labelled.select(F.col(id_col).alias("id"), half_of(F.col(id_col)).alias("half"), primary_subtag(F.col(label_col)).alias("label"), F.col(text_col).alias("text")).where("label <> '' and text is not null")
    sizes = {r.label: r.n for r in tagged.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return TextModel(["und"], np.full((1, 1, CODES), -np.log(CODES), np.float32))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n)))), F.col("label"))
    sample = tagged.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("label", "half", "text")
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, str], np.ndarray] = {}
        for batch in text_batches(batches, 2):
            for label, half, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = trigram_codes(text)
                if (half, label) not in totals:
                    totals[half, label] = np.zeros(CODES, np.int64)
                np.add.at(totals[half, label], codes, 1)
        for (half, label), total in totals.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), half, np.int32)), pa.array([label] * len(code), pa.string()), pa.array(code), pa.array(total[code])], names=["half", "label", "code", "n"])

    counts = sample.mapInArrow(lean("language_id", count), "half int, label string, code long, n long").groupBy("half", "label", "code").agg(F.sum("n").alias("n"))
    own = np.zeros((2, len(languages), CODES))
    for r in counts.toLocalIterator():  # at most CODES rows for each half of a language
        own[r.half, number[r.label], r.code] += r.n
    table = (own[::-1] if halves else own.sum(0, keepdims=True)) + 0.5
    return TextModel(languages, np.log(table / table.sum(2, keepdims=True)).astype(np.float32))


def log_likelihood(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The tempered log-likelihood of a text's codes by language; memory is bounded by the table, whatever the text."""
    if len(codes) > CODES // 4:
        counts = np.bincount(codes, minlength=CODES)
        at = np.flatnonzero(counts)
        return (table[:, at] * counts[at]).sum(1, dtype=np.float64) * TEMPER
    return table[:, codes].sum(1, dtype=np.float64) * TEMPER


def text_scores(docs: DataFrame, model: TextModel, columns: dict[str, Column], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns named, text_ll array<double> (tempered log-likelihood by language) and n_trigrams, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table)  # CODES numbers for each half of a language
    half = half_of(F.col(id_col)) if len(model.table) == 2 else F.lit(0)
    rows = docs.select(F.col(text_col).alias("_text"), half.alias("_half"), *(c.alias(k) for k, c in columns.items()))
    kinds = ", ".join(f"{k} {t}" for k, t in rows.dtypes[2:])
    names = [*columns, "text_ll", "n_trigrams"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_batches(batches, 0):
            codes = [trigram_codes(t) for t in batch.column(0).to_pylist()]
            scores = [log_likelihood(table[h], c).tolist() for h, c in zip(batch.column(1).to_pylist(), codes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(scores, pa.list_(pa.float64())), pa.array([len(c) for c in codes], pa.int64())], names=names)

    return rows.mapInArrow(lean("language_id", run), f"{kinds}, text_ll array<double>, n_trigrams long")


def _argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _smoothed(counts: DataFrame, keys: list[str], parent: DataFrame | list[float], parent_keys: list[str], n: int, smooth: float) -> DataFrame:
    """keys, prior array<double>: counts(keys..., guess, n) smoothed towards the parent's prior, a table by parent_keys or the numbers themselves."""
    own = counts.groupBy(*keys).agg(*(F.sum(F.when(F.col("guess") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(n)), F.sum("n").alias("total"))
    joined = own.withColumn("_parent", F.array(*map(F.lit, parent))) if isinstance(parent, list) else own.join(parent.withColumnRenamed("prior", "_parent"), parent_keys)
    prior = F.array(*((F.col(f"c{i}") + smooth * F.get("_parent", F.lit(i))) / (F.col("total") + smooth) for i in range(n)))
    return joined.select(*keys, prior.alias("prior"))


def identify(docs: DataFrame, model: TextModel, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, key (a hash of the text), language, confidence, text_language, accepted for each row of docs.

    declared, suffix and host are expressions over docs; absent or null ones count as empty. A text
    without trigrams (null, empty, no letters) has language "und", confidence 0 and isn't accepted; else a
    document is accepted at a posterior of min_confidence or more. Of equal posteriors the first language by name wins.
    """
    n = len(model.languages)
    blank = F.lit("")
    columns = {"doc_id": F.col(id_col).cast("long"), "key": F.xxhash64(F.col(text_col)), "declared": primary_subtag(declared if declared is not None else blank), "suffix": F.coalesce(suffix, blank) if suffix is not None else blank, "host": F.coalesce(host, blank) if host is not None else blank}
    scored = checkpoint(text_scores(docs, model, columns, text_col, id_col).withColumn("guess", _argmax(F.col("text_ll"))))
    known = scored.where("n_trigrams > 0")
    by_declared = {(r.guess, r.declared): r.n for r in known.groupBy("guess", "declared").agg(F.count("*").alias("n")).collect()}  # languages x subtags
    tags = sorted({d for _, d in by_declared})
    totals = [sum(by_declared.get((i, d), 0) for d in tags) for i in range(n)]
    likelihood = {d: [float(np.log((by_declared.get((i, d), 0) + 1) / (totals[i] + len(tags) + 1))) for i in range(n)] for d in tags}
    table = F.create_map(*(x for d, row in likelihood.items() for x in (F.lit(d), F.array(*map(F.lit, row))))) if tags else None
    whole = [(t + 1.0) / (sum(totals) + n) for t in totals]
    counts = known.groupBy("suffix", "host", "guess").agg(F.count("*").alias("n"))
    by_suffix = _smoothed(counts, ["suffix"], whole, [], n, SMOOTH)
    by_host = checkpoint(_smoothed(counts, ["suffix", "host"], by_suffix, ["suffix"], n, SMOOTH))
    by_host = F.broadcast(by_host) if by_host.count() <= MAX_BROADCAST_ROWS else by_host
    joined = scored.join(by_host, ["suffix", "host"], "left")
    said = F.element_at(table, F.col("declared")) if table is not None else F.lit(None).cast("array<double>")
    parts = joined.withColumn("_said", said)
    total = F.transform("text_ll", lambda x, i: x + F.coalesce(F.get("_said", i), F.lit(0.0)) + F.coalesce(F.log(F.get("prior", i)), F.lit(0.0)))
    parts = parts.withColumn("_total", total)
    confidence = F.lit(1.0) / F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_total")))
    names = F.array(*map(F.lit, model.languages))
    some = F.col("n_trigrams") > 0
    return parts.select(
        "doc_id",
        "key",
        F.when(some, F.get(names, _argmax(F.col("_total")))).otherwise("und").alias("language"),
        F.when(some, confidence).otherwise(0.0).alias("confidence"),
        F.when(some, F.get(names, F.col("guess"))).otherwise("und").alias("text_language"),
        (some & (confidence >= min_confidence)).alias("accepted"),
    )


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with declared (the lang of the html element), host and suffix (the last label of the host); empty where absent."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    declared = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z0-9_-]+)", 1)
    return pages.withColumn("declared", declared).withColumn("host", host).withColumn("suffix", F.regexp_extract(F.col("host"), r"([^.]+)\.?$", 1))


def keep_accepted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the rows that `found` (of identify) doesn't accept."""
    doc, key = fresh(docs, "_doc", "_key")
    bad = checkpoint(found.where(~F.col("accepted")).select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct())
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_ROWS else bad
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(key)), "left_anti")


def identify_documents(docs: DataFrame) -> DataFrame:
    """The documents table: `lang` is what is declared, and labels the training rows of the other half; `source` is the host."""
    return identify(docs, train_text_model(docs, halves=True), declared=F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, language, confidence, text_language, accepted, declared, host of web pages: text without tags, scripts and styles, by models
    fitted on labelled(doc_id, text, lang), with the evidence of markup, address suffix and host."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?[a-zA-Z0-9]+;", " ")
    read = page_evidence(pages.select("page_id", "url", "html")).withColumn("text", bare)
    found = identify(read, train_text_model(labelled), F.col("declared"), F.col("suffix"), F.col("host"), "page_id")
    names = read.select(F.col("page_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "declared", "host").dropDuplicates(["doc_id", "key"])
    return found.join(names, found.doc_id.eqNullSafe(names.doc_id) & (found.key == names.key)).select(found.doc_id.alias("page_id"), "language", "confidence", "text_language", "accepted", "declared", "host")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, its confidence, and whether it is kept."""
    found = identify_documents(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", "confidence", "text_language", F.col("accepted").alias("kept"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's language, by its text, markup, address suffix and host."""
    return identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": op8_language_id, "language_of_pages": language_of_pages}
ORACLE_SQL: dict[str, str] = {}
