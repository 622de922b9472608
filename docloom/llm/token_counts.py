"""Token counts by finite-state transducers.

`WordTransducer` is a deterministic automaton over the bytes of words. A transition says how many
tokens the word's code gains by its byte (it may lose some: merges), so the sum along a path is the
token count of the word spelled by it. It holds all prefixes of the vocabulary's own entries; words
that leave it are merged exactly. A text's chunk is a map from the state before it to the state after it and the tokens
emitted, kept in closed form as `ChunkState`: how it ends the word that is open at its start (the state before it), the
tokens of its closed words, and the word that it leaves open (the state after it). Chunk maps compose by an associative
operation. A long text's chunks are rows of their own, read by any tasks, and their maps are composed by a
parallel scan: rounds that join FAN neighbours each until one map is left of every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import CUT, LAST_CUT, WORDS, Vocabulary, vocabulary
from docloom.llm.common import cached, checkpoint, lean, read_table, text_batches

#: Characters of a chunk; longer texts are counted in chunks.
CHUNK_CHARS = 65_536
#: Neighbouring chunks whose maps one step of the scan composes.
FAN = 8
CACHED_WORDS = 200_000


class WordTransducer:
    """Arcs sorted by (state, byte): `keys` is state * 256 + byte, `targets` the next state, `gains` the tokens gained."""

    def __init__(self, vocab: Vocabulary):
        states: dict[bytes, int] = {b"": 0}
        counts, keys, targets, gains = [0], [], [], []
        for entry in sorted(vocab.ids):
            at = 0
            for i in range(len(entry)):
                prefix = entry[: i + 1]
                state = states.get(prefix)
                if state is None:
                    state = states[prefix] = len(counts)
                    counts.append(len(vocab.merge(prefix)))
                    keys.append(at << 8 | entry[i])
                    targets.append(state)
                    gains.append(counts[state] - counts[at])
                at = state
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.targets = np.array(targets, np.int64)[order]
        self.gains = np.array(gains, np.int64)[order]

    def run(self, words: list[bytes]) -> np.ndarray:
        """The token count of each word by its path; -1 where a word leaves the automaton."""
        text = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        state, total, live, step = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.flatnonzero(sizes), 0
        while len(live):
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            total[live[~found]] = -1
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            total[live] += self.gains[at]
            step += 1
            live = live[sizes[live] > step]
        return total


class ChunkState(NamedTuple):
    """What a chunk does: `head` ends the word open before it, `closed` counts tokens, `tail` stays open. Without a cut in the chunk, head is all of it and tail None."""

    head: str
    closed: int
    tail: str | None


class TokenCounter:
    """Counts tokens; remembers the counts of words seen, up to a bound."""

    def __init__(self, payload: bytes):
        self.vocab = vocabulary(payload)
        self.transducer = WordTransducer(self.vocab)
        self.counts: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.counts]
        spelled = [w.encode() for w in new]
        for word, raw, n in zip(new, spelled, self.transducer.run(spelled).tolist() if new else (), strict=True):
            self.counts[word] = n if n >= 0 else len(self.vocab.merge(raw))

    def count_each(self, texts: list[str]) -> list[int]:
        if len(self.counts) > CACHED_WORDS:
            self.counts.clear()
        parts = [[WORDS.findall(p) for p in self.vocab.parts(t)[::2]] for t in texts]
        self.learn(set().union(*(words for text in parts for words in text)))
        get = self.counts.__getitem__
        return [len(text) - 1 + sum(sum(map(get, words)) for words in text) for text in parts]

    def state(self, chunk: str) -> ChunkState:
        first = CUT.search(chunk)
        if not first:
            return ChunkState(chunk, 0, None)
        last = LAST_CUT.search(chunk)
        return ChunkState(chunk[: first.start()], self.count_each([chunk[first.start() : last.start()]])[0], chunk[last.start() :])

    def compose(self, a: ChunkState, b: ChunkState) -> ChunkState:
        if a.tail is None:
            joined = a.head + b.head
            if CUT.match(joined, len(a.head)):  # the cut lies where the two meet
                return ChunkState(a.head, b.closed + self.count_each([b.head])[0], b.tail) if b.tail is not None else ChunkState(a.head, 0, b.head)
            return ChunkState(joined, b.closed, b.tail)
        if b.tail is None:
            if CUT.match(a.tail + b.head, len(a.tail)):
                return ChunkState(a.head, a.closed + self.count_each([a.tail])[0], b.head)
            return ChunkState(a.head, a.closed, a.tail + b.head)
        return ChunkState(a.head, a.closed + sum(self.count_each([a.tail + b.head])) + b.closed, b.tail)

    def scan(self, states: list[ChunkState]) -> ChunkState:
        """All chunks' maps composed pairwise, level by level."""
        while len(states) > 1:
            states = [self.compose(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
        return states[0]

    def finish(self, done: ChunkState) -> int:
        """The tokens of a text whose chunks' maps are composed: nothing is open before it."""
        return done.closed + sum(self.count_each([done.head, done.tail or ""]))

    def count_long(self, text: str, size: int = CHUNK_CHARS) -> int:
        return self.finish(self.scan([self.state(text[i : i + size]) for i in range(0, len(text), size)] or [ChunkState("", 0, None)]))


@cached("token_counts")
def counter(payload: bytes) -> TokenCounter:
    return TokenCounter(payload)


_STATE = "head string, closed long, tail string"


def long_counts(texts: DataFrame, payload: Broadcast, size: int = CHUNK_CHARS) -> DataFrame | None:
    """doc_id, n_bytes, n_tokens of texts(doc_id, n_bytes, text), None without any: chunks are rows, and FAN neighbours' maps become one in each round."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(payload.value)
        for batch in text_batches(batches, 4):
            states = list(zip(*(count.state(t) for t in batch.column(4).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *_columns(states)], names=["doc_id", "n_bytes", "key", "at", "head", "closed", "tail"])

    def compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(payload.value)
        for batch in batches:
            states = [count.scan([ChunkState(p["head"], p["closed"], p["tail"]) for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(list(zip(*states, strict=True)))], names=["key", "at", "head", "closed", "tail"])

    def end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(payload.value)
        for batch in batches:
            states = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count.finish(ChunkState(*s)) for s in states], pa.int64())], names=["key", "n_tokens"])

    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    chunks = texts.withColumn("key", F.md5(F.col("text").cast("binary"))).select("doc_id", "n_bytes", "key", F.posexplode_outer(pieces).alias("at", "text"))
    chunks = chunks.select("doc_id", "n_bytes", "key", F.col("at").cast("long").alias("at"), "text")
    states = checkpoint(chunks.mapInArrow(lean("token_counts", read), f"doc_id long, n_bytes long, key string, at long, {_STATE}"))
    names, most = states.where("at = 0").select("doc_id", "n_bytes", "key"), states.agg(F.max("at")).first()[0]
    if most is None:
        return None
    while most:  # of equal texts, which have the same key, one goes on
        part = F.struct(F.col("at").alias("i"), "head", "closed", "tail")
        grouped = states.groupBy("key", F.floor(F.col("at") / FAN).cast("long").alias("at")).agg(F.array_sort(F.collect_set(part)).alias("parts"))
        states = checkpoint(grouped.mapInArrow(lean("token_counts", compose), f"key string, at long, {_STATE}"))
        most //= FAN
    counts = states.select("key", "head", "closed", "tail").mapInArrow(lean("token_counts", end), "key string, n_tokens long")
    return names.join(counts, "key").select("doc_id", "n_bytes", "n_tokens")


def _columns(states: list) -> list[pa.Array]:
    head, closed, tail = states or ((), (), ())
    return [pa.array(head, pa.string()), pa.array(closed, pa.int64()), pa.array(tail, pa.string())]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs, by the byte-level BPE in the JSON file at tokenizer_path.

    Null texts count as empty: 0 bytes, 0 tokens. Rows repeat as they do in docs; other columns are
    not read. Special strings inside a text count as their one token. Texts above `size` characters are counted in chunks of it,
    by as many tasks as there are.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        payload = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(payload.value)
        for batch in text_batches(batches):
            counts = count.count_each([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    whole = F.length("text") <= size
    short = rows.where(whole).mapInArrow(lean("token_counts", run), "doc_id long, n_bytes long, n_tokens long")
    long = long_counts(rows.where(~whole).select("doc_id", "n_bytes", "text"), payload, size)
    return short if long is None else short.unionAll(long)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens) of every document."""
    import public_tokenizers

    counts = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
