"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The words found in most documents are counted over the whole corpus and compiled into a minimal
acyclic automaton: equal endings share states. Each arc carries an additive output; the outputs along
a word's path sum to its number, which points to its ids. The automaton is a flat file that each
Python worker maps into memory. Words outside it are merged exactly.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import WORDS, Vocabulary, pieces_of, vocabulary
from docloom.llm.common import PIECE_CHARS, cached, lean, read_table, text_batches

LEXICON_WORDS = 65_536
CACHED_WORDS = 200_000
DEAD = -1


def compile_lexicon(words: Iterable[bytes], vocab: Vocabulary) -> bytes:
    """The minimal acyclic transducer of the words, as one flat image: int64 sizes, then the arrays in order.

    States are made from the sorted words; a state whose arcs and finality equal those of one made
    before is replaced by it as soon as no word can extend it.
    """
    words = sorted(set(words))
    made: dict[tuple, int] = {}  # finality and arcs -> number of the state
    arcs_of: list[tuple[tuple[int, int], ...]] = []
    final_of: list[bool] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in made:
            made[key] = len(arcs_of)
            arcs_of.append(key[1])
            final_of.append(key[0])
        return made[key]

    path: list[list] = [[False, []]]  # open states of the last word: [final, arcs]
    last = b""
    for word in words:
        same = len(os.path.commonprefix([last, word]))
        for i in range(len(last), same, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[i - 1], state))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        state = freeze(path.pop())
        path[-1][1].append((last[i - 1], state))
    root = freeze(path[0])

    below: list[int] = []  # words that can be spelled from each state; targets are made before sources
    keys, targets, skips = [], [], []
    for state, arcs in enumerate(arcs_of):
        n = int(final_of[state])
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below.append(n)
    codes = [vocab.merge(w) if w else [] for w in words]
    ends = np.cumsum([len(c) for c in codes], dtype=np.int64) if codes else np.zeros(0, np.int64)
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array(final_of, np.int64), ends, np.array([i for c in codes for i in c], np.int32)]
    return b"".join(a.tobytes() for a in [np.array([root, *map(len, arrays)], np.int64), *arrays])


class Lexicon:
    """A compiled lexicon, read in place from any buffer."""

    def __init__(self, image):
        sizes = np.frombuffer(image, np.int64, 7)
        self.root, at, arrays = int(sizes[0]), 56, []
        for kind, n in zip((np.int64,) * 5 + (np.int32,), sizes[1:].tolist(), strict=True):
            arrays.append(np.frombuffer(image, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.skips, self.final, self.ends, self.ids = arrays

    @classmethod
    def mapped(cls, image: bytes) -> Lexicon:
        """Through a memory-mapped file of the worker's own, without a name once it is mapped."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word among the sorted words of the lexicon, or -1."""
        text = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        state, number, live, step = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.flatnonzero(sizes), 0
        while len(live) and len(self.keys):
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[live[~found]] = DEAD
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            number[live] += self.skips[at]
            step += 1
            live = live[sizes[live] > step]
        done = (state != DEAD) & (self.final[state] == 1) if len(self.keys) else np.zeros(len(words), bool)
        return np.where(done, number, -1)

    def code(self, number: int) -> np.ndarray:
        return self.ids[self.ends[number - 1] if number else 0 : self.ends[number]]


class Codec:
    """Text to ids and back; remembers the codes of words seen, up to a bound."""

    def __init__(self, payload: bytes, image: bytes):
        self.vocab = vocabulary(payload)
        self.lexicon = Lexicon.mapped(image)
        self.codes: dict[str, bytes] = {}
        pieces = [self.vocab.pieces.get(i, b"") for i in range(max(self.vocab.pieces) + 1)]
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(pieces), np.uint8)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.codes]
        spelled = [w.encode() for w in new]
        for word, raw, n in zip(new, spelled, self.lexicon.numbers(spelled).tolist() if new else (), strict=True):
            self.codes[word] = self.lexicon.code(n).tobytes() if n >= 0 else np.array(self.vocab.merge(raw), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids as int32."""
        out = []
        for k, part in enumerate(self.vocab.parts(text)):
            if k % 2:
                out.append(np.int32(self.vocab.special[part]).tobytes())
                continue
            for piece in pieces_of(part, PIECE_CHARS):
                words = WORDS.findall(piece)
                self.learn(set(words))
                out += map(self.codes.__getitem__, words)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.letters[at].tobytes().decode("utf-8", "replace")

    def forget(self) -> None:
        if len(self.codes) > CACHED_WORDS:
            self.codes.clear()


@cached("bpe", size=2)
def codec(payload: bytes, image: bytes) -> Codec:
    return Codec(payload, image)


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """word, n: the `most` words found in most documents, over all documents; words are letters after a space."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in text_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                counts.update([w for w in set((text or "").split(" ")) if w.isalpha()])
            if len(counts) > CACHED_WORDS:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean("bpe", count), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """The lexicon image of the corpus; `most` bounds what reaches the driver."""
    with open(tokenizer_path, "rb") as f:
        vocab = vocabulary(f.read())
    return compile_lexicon(((" " + r.word).encode() for r in frequent_words(docs, text_col, most).toLocalIterator()), vocab)


def bpe_encode(docs: DataFrame, tokenizer_path: str, image: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids array<int> for each row of docs; with decode=True also `decoded`, the text of these ids.

    Null texts count as empty and have no ids. Rows repeat as they do in docs; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), image))  # a vocabulary and a lexicon of at most LEXICON_WORDS words: a few MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in text_batches(batches):
            codes = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, codes)])
            ids = pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]
            if decode:
                columns.append(pa.array([own.decode(c) for c in codes], pa.string()))
            own.forget()
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean("bpe", run), "doc_id long, ids array<int>" + ", decoded string" * decode)


def bpe_decode(codes: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for each row of codes; null ids give an empty text."""
    spark = codes.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), EMPTY_IMAGE))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            texts = [own.decode([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return codes.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lean("bpe", run), "doc_id long, text string")


#: A lexicon without words.
EMPTY_IMAGE = np.array([0, 0, 0, 0, 1, 0, 0, 0], np.int64).tobytes()


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's code by byte_bpe_50k.json and the text that it decodes to, as digests."""
    import public_tokenizers

    docs, path = read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return digests(bpe_encode(docs, path, build_lexicon(docs, path), decode=True))


QUERIES = {"op7_bpe_encode_decode": op7_bpe_encode_decode}
ORACLE_SQL: dict[str, str] = {}
