"""The pipeline on the smallest documents: each stage keeps what it should, and the last one gives the library's ids."""

import hashlib
import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm.common import ensure_checkpoint_dir
from docloom.llm.decontamination import contamination
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.pii import find

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    extra = [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "!!! 123", "en", "s", 7)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema)).unionAll(docs.where("doc_id < 3")).checkpoint()
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).checkpoint()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe":
            assert docs.columns == columns
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()}
    assert kept["language_id"] == ids
    found = near_duplicates(spark.read.parquet(f"{SF}/documents.parquet").limit(150))
    assert kept["near_dedup"] == {r.doc_id for r in found.where("kept").collect()}
    assert before.groupBy("doc_id").count().where("count > 1").isEmpty()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in contamination(spark.read.parquet(f"{SF}/documents.parquet"), bench).where("contaminated").collect()}
    assert kept["decontamination"] == kept["near_dedup"] - bad
    original = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r for r in before.collect()}
    for i, r in texts.items():
        old = original[i].text
        assert (r.text == old) == (not find(old)) and r.n_chars == (len(r.text) if r.text != old else original[i].n_chars)
    for r in docs.collect():
        assert r.ids == library.encode(texts[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_clashing_columns_repeated_ids_and_long_texts(spark):
    """Columns with names used inside stay; distinct texts of one id stay; equal rows and near copies go."""
    words = [f"w{i}" for i in range(300)]
    near = " ".join([*words[:-1], "other"])
    texts = [(1, " ".join(words)), (1, " ".join(words)), (1, " ".join(f"v{i}" for i in range(90))), (2, near), (3, "long " + " ".join(f"k{i % 977}x{i // 977}" for i in range(60_000))), (None, "no id at all")]
    names = ["_row", "_n_entities", "_doc", "_key", "key", "kept", "cluster", "_cluster"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{n}!" for n in names]) for i, t in texts], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{n} string" for n in names)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns[5:] == names and all(r[n] == f"{n}!" for r in docs.select(*names).collect() for n in names)
        if name == "near_dedup":
            got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
            assert got == sorted([texts[0], texts[2], texts[4], texts[5]], key=repr)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_ids_are_decoded(spark):
    texts = {1: "Hello  world, it's\n2026!", 2: "Ünï 日本", 3: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.decoded_md5 for r in corpus_pipeline.bpe(spark, docs, SF).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts.items()}


def test_all_personal_data_is_replaced(spark):
    docs = spark.createDataFrame([(1, "mail someone@mail.example.com now", "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.pii(spark, docs, SF).first()
    assert "someone@" not in row.text and row.n_chars == len(row.text)
    assert corpus_pipeline.pii(spark, docs.select(F.col("doc_id"), F.lit("clean").alias("text"), "lang", "source", "n_chars"), SF).first().n_chars == 33
