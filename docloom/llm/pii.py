"""PII: detected entities receive keyed surrogates of the same type and format.

A surrogate comes from a keyed permutation of all strings of the entity's own pattern (letters stay
letters of their script and case, digits digits, given names stay in the list of their gender), so different entities
never share one, and an entity has the same one wherever it is found and however it is punctuated. Names are replaced word by word,
so that a person named in full, by family name or by given name stays one person. A check over the corpus finds surrogates that are
real entities of the corpus, and moves their entities to another permutation until none is left; an entity that finds none
in ATTEMPTS permutations gets a surrogate longer than itself.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LOWER, UPPER, cached, checkpoint, fresh, lean, read_table, text_batches

DEFAULT_KEY = b"docloom surrogates"
MAX_BROADCAST_ROWS = 500_000

#: Permutations tried for an entity before its surrogate is made longer.
ATTEMPTS = 8
DIGITS = "0123456789"


#: Code points of the plain Greek and Cyrillic letters.
PLAIN = [range(0x391, 0x3AA), range(0x3B1, 0x3CA), range(0x410, 0x450)]


def _alphabets() -> list[str]:
    """Letters that may stand for each other: those of one script and case; ASCII, the accented Latin letters up to U+017F, and plain Greek and Cyrillic ones are kept to themselves."""
    groups: dict[tuple[str, str, int], list[str]] = defaultdict(list)
    for n in range(0xC0, 0x10000):
        c = chr(n)
        if (case := unicodedata.category(c)) in ("Ll", "Lu"):
            groups["accented" if n < 0x180 else unicodedata.name(c).split(" ")[0], case, 2 if n >= 0x1E00 else any(n in r for r in PLAIN)].append(c)
    return [DIGITS, LOWER, UPPER, *map("".join, groups.values())]


#: By character: the alphabet it belongs to, and its place there.
PLACE_OF = {c: (a, i) for a in _alphabets() for i, c in enumerate(a)}

#: Given names by script and gender.
GIVEN = [
    ["Anna", "Alice", "Carla", "Clara", "Emma", "Eva", "Grace", "Hannah", "Helen", "Ida", "Jane", "Julia", "Laura", "Lucy", "Maria", "Marie", "Mary", "Nina", "Paula", "Rosa", "Sarah", "Sofia"],
    ["Adam", "Albert", "Carlos", "David", "Felix", "Frank", "George", "Henry", "Hugo", "James", "John", "Jose", "Louis", "Lucas", "Mark", "Martin", "Max", "Paul", "Peter", "Robert", "Thomas", "Victor"],
    ["Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"],
    ["Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Сергей"],
    ["Ελένη", "Μαρία", "Σοφία", "Άννα"],
    ["Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος"],
]
GIVEN_AT = {n: (names, i) for names in GIVEN for i, n in enumerate(names)}
TITLES = r"Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа|Κύριος|Κυρία"
#: What a person says before the own name.
CUES = r"[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*"
_NAME = rf"{_WORD}(?:-{_WORD})?"
#: kind, what a text must hold for it to be looked for, pattern (group "v" is what is replaced); earlier kinds win where two overlap.
KINDS = [
    ("email", "@", r"(?<![\w.%+-])(?P<v>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w-])"),
    ("key", "AKIA", r"(?<![A-Za-z0-9])(?P<v>AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("secret", None, r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}(?P<q>[\"']?)(?=[A-Za-z0-9_/+-]*\d)(?P<v>[A-Za-z0-9_/+-]{8,})(?P=q)"),
    ("card", DIGITS, r"(?<![\d.])(?P<v>\d(?:[ -]?\d){12,18})(?!\.?\d)"),
    ("ssn", DIGITS, r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])"),
    ("phone", DIGITS, r"(?<![\w+.-])(?P<v>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4})(?!\d)"),
    ("ip", DIGITS, rf"(?<![\w.])(?P<v>(?:{_OCTET}\.){{3}}{_OCTET})(?!\.?\d)"),
    ("name", None, rf"(?<!\w)(?:(?:{TITLES})\.?|{CUES}) (?P<v>{_NAME}(?: {_NAME}){{0,2}})"),
]
_COMPILED = [(kind, needs, regex.compile(p)) for kind, needs, p in KINDS]
_ANY_DIGIT = regex.compile(r"[0-9]")
_ANY_NAME = regex.compile(f"{TITLES}|{CUES}")
_ANY_SECRET = regex.compile(r"[=:]")
_NAME_WORD = regex.compile(rf"(?<!\w){_WORD}(?!\w)")
_NUMBER = regex.compile(r"\d+")


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))


def _cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The card numbers in a run of digit groups: the longest rows of whole groups whose check digit holds, from the left."""
    groups = [m.span() for m in _NUMBER.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        for j in range(len(groups), i, -1):
            digits = "".join(text[a:b] for a, b in groups[i:j])
            if 13 <= len(digits) <= 19 and luhn_sum(digits) % 10 == 0:
                yield groups[i][0], groups[j - 1][1]
                i = j - 1
                break
        i += 1


class _Spans:
    """Spans without overlaps: what comes first stays."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, str]] = []

    def add(self, new: Iterable[tuple[int, int, str]]) -> None:
        """Spans in order and apart from each other."""
        more = []
        for span in new:
            at = bisect(self.found, span)
            if (at == 0 or self.found[at - 1][1] <= span[0]) and (at == len(self.found) or self.found[at][0] >= span[1]):
                more.append(span)
        if more:
            self.found = sorted(self.found + more)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps; names word by word.

    A name is found after a title or a cue; its words are then found wherever they stand alone in the text.
    """
    digits = bool(_ANY_DIGIT.search(text))
    spans = _Spans()
    for kind, needs, pattern in _COMPILED:
        if needs is DIGITS or kind == "secret":
            if not digits or kind == "secret" and not _ANY_SECRET.search(text):
                continue
        elif needs is None:
            if not _ANY_NAME.search(text):
                continue
        elif needs not in text:
            continue
        places = [m.span("v") for m in pattern.finditer(text)]
        if kind == "card":
            places = [x for a, b in places for x in _cards(text, a, b)]
        if kind == "name" and places:
            words = {m[0] for a, b in places for m in _NAME_WORD.finditer(text, a, b)}
            places = [m.span() for m in _NAME_WORD.finditer(text) if m[0] in words]
        spans.add((a, b, kind) for a, b in places)
    return spans.found


def canonical(kind: str, text: str) -> str:
    """The same string for all spellings of an entity."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c in DIGITS or c == "+")
    return text.lower() if kind == "email" else text


def permute(n: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size): a Feistel network of eight rounds, walked until it falls in range."""
    if size < 2:
        return n
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, width = (1 << half) - 1, half + 7 >> 3
    while True:
        a, b = n >> half, n & mask
        for r in range(8):
            mixed = int.from_bytes(hashlib.shake_256(key + bytes([r]) + b.to_bytes(width, "big")).digest(width), "big")
            a, b = b, a ^ mixed & mask
        n = a << half | b
        if n < size:
            return n


def recode(text: str, key: bytes, fixed: frozenset[int] = frozenset()) -> str:
    """Another string of the same pattern; the places in `fixed`, and characters of no alphabet, stay."""
    at = [i for i, c in enumerate(text) if c in PLACE_OF and i not in fixed]
    n, size = 0, 1
    for i in at:
        alphabet, place = PLACE_OF[text[i]]
        n, size = n * len(alphabet) + place, size * len(alphabet)
    pattern = "".join(PLACE_OF[text[i]][0][0] for i in at)
    n, out = permute(n, size, key + pattern.encode()), list(text)
    for i in reversed(at):
        alphabet, _ = PLACE_OF[text[i]]
        n, own = divmod(n, len(alphabet))
        out[i] = alphabet[own]
    return "".join(out)


def _other(n: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size) that moves every number: the next one on a keyed circle."""
    places = [permute(i, size, key) for i in range(size)]
    return places.index((places[n] + 1) % size)


def _name_word(word: str, key: bytes) -> str:
    """Given names become others of their gender; of other words the last letter, which often shows the gender, stays."""
    if word in GIVEN_AT:
        names, i = GIVEN_AT[word]
        return names[_other(i, len(names), key + names[0].encode())]
    new = word
    while True:
        new = recode(new, key, frozenset([len(word) - 1]))
        if new not in GIVEN_AT:
            return new


def _longer(text: str, key: bytes) -> str:
    """A string that begins like text, as far as it can vary, and ends with 16 letters (digits, for digits) that text and key decide."""
    alphabet = DIGITS if text[-1:] in DIGITS else LOWER
    n = int.from_bytes(hashlib.blake2b(text.encode(), key=key, digest_size=16).digest(), "big")
    return text[:1] + "".join(alphabet[n // len(alphabet) ** i % len(alphabet)] for i in range(16))


@cached("pii", size=50_000)
def surrogate(kind: str, canon: str, secret: bytes, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    key = hashlib.blake2b(kind.encode(), key=hashlib.blake2b(secret + attempt.to_bytes(4, "big"), digest_size=32).digest(), digest_size=16).digest()
    if attempt >= ATTEMPTS:
        local, at, domain = canon.partition("@")
        return _longer(local, hashlib.blake2b(domain.encode(), key=key, digest_size=16).digest()) + at + domain if kind == "email" else _longer(canon, key)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{recode(local, key)}@{'.'.join(recode(x, key) for x in labels.split('.'))}.{top}"
    if kind == "key":
        return recode(canon, key, frozenset(range(4)))
    if kind == "card":
        body = recode(canon[:-1], key, frozenset([0]))
        return body + str(-luhn_sum(body + "0") % 10)
    if kind == "phone":
        return recode(canon, key, frozenset(range(max(0, len(canon) - 10))))
    if kind == "ip":
        parts = list(map(int, canon.split(".")))
        n = permute(((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3], 256**4, key)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    return _name_word(canon, key) if kind == "name" else recode(canon, key)


def render(kind: str, text: str, canon: str) -> str:
    """A surrogate's canonical form, spelled as the entity it stands for; what a longer one has beyond it comes at the end."""
    if kind in ("phone", "card", "ssn"):
        new = iter(c for c in canon if c in DIGITS)
        return "".join(next(new) if c in DIGITS else c for c in text) + "".join(new)
    if kind == "email" and len(text) == len(canon):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(text, canon, strict=True))
    return canon


def _entity_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [(i, k, kind, canon) for i, k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for kind, canon in {(kind, canonical(kind, t[a:b])) for a, b, kind in find(t)}]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc", "key", "kind", "canon"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    return rows.mapInArrow(lean("pii", run), "doc long, key long, kind string, canon string")


def _with_surrogates(entities: DataFrame, secret: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, c, secret, attempt) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canon", "new"])

    return entities.select("kind", "canon").mapInArrow(lean("pii", run), "kind string, canon string, new string")


def moved_entities(entities: DataFrame, secret: bytes) -> DataFrame | None:
    """kind, canon, attempt of the entities whose first surrogate is an entity of the corpus; None without any.

    entities(kind, canon) are distinct. Each attempt is another permutation; it is taken where the surrogate is
    neither an entity nor any surrogate of an attempt before. From ATTEMPTS on surrogates are longer than entities
    and end in 16 keyed letters or digits, so that a round more than that is next to impossible. Listed given names stand for
    each other whoever else has them, and are never moved.
    """
    entities = entities.where(~((F.col("kind") == "name") & F.col("canon").isin(list(GIVEN_AT))))
    new = checkpoint(_with_surrogates(entities, secret, 0))
    taken = entities.select("kind", "canon").unionAll(new.select("kind", F.col("new").alias("canon")))
    pending = checkpoint(new.join(entities.select("kind", F.col("canon").alias("new")), ["kind", "new"], "left_semi").select("kind", "canon"))
    done: DataFrame | None = None
    attempt = 0
    while not pending.isEmpty():
        attempt += 1
        tried = checkpoint(_with_surrogates(pending, secret, attempt))
        again = tried.groupBy("kind", "new").agg(F.count("*").alias("n")).where("n > 1").select("kind", "new")
        met = taken.select("kind", F.col("canon").alias("new")).unionAll(again).distinct()
        clash = checkpoint(tried.join(met, ["kind", "new"], "left_semi").select("kind", "canon"))
        settled = tried.join(clash, ["kind", "canon"], "left_anti").select("kind", "canon", F.lit(attempt).alias("attempt"))
        done = settled if done is None else done.unionAll(settled)
        taken = taken.unionAll(tried.select("kind", F.col("new").alias("canon")))
        pending = clash
    return done


def replace_entities(docs: DataFrame, secret: bytes = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """docs with all its columns, its text with surrogates for the entities found.

    count_col and kinds_col name columns to add: how many entities were replaced (each word of a name is one), and
    their kinds (sorted, comma-joined). Null and empty texts stay and have none; rows repeat as they do in docs.
    """
    found = checkpoint(_entity_table(docs, id_col, text_col))
    moved = moved_entities(checkpoint(found.select("kind", "canon").distinct()), secret)
    names = docs.columns
    doc, key, more = fresh(docs, "_doc", "_key", "_moved")
    if moved is not None:
        own = found.join(moved, ["kind", "canon"]).groupBy("doc", "key").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias(more))
        own = checkpoint(own.withColumnsRenamed({"doc": doc, "key": key}))
        own = F.broadcast(own) if own.count() <= MAX_BROADCAST_ROWS else own
        same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(key))
        rows = docs.join(own, same, "left").select(*(docs[c] for c in names), more)
    else:
        rows = docs.withColumn(more, F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>"))
    added = [(c, t) for c, t in ((count_col, T.LongType()), (kinds_col, T.StringType())) if c]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in added)])
    at, out_names = names.index(text_col), [*names, *(c for c, _ in added)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, at):
            texts, counts, kinds = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans = find(text) if text else []
                attempts = {(m["kind"], m["canon"]): m["attempt"] for m in own or ()}
                out, last = [], 0
                for a, b, kind in spans:
                    canon = canonical(kind, text[a:b])
                    out += [text[last:a], render(kind, text[a:b], surrogate(kind, canon, secret, attempts.get((kind, canon), 0)))]
                    last = b
                texts.append("".join([*out, text[last:]]) if spans else text)
                counts.append(len(spans))
                kinds.append(",".join(sorted({k for _, _, k in spans})))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            own_columns = [pa.array(v, t) for c, v, t in ((count_col, counts, pa.int64()), (kinds_col, kinds, pa.string())) if c]
            yield pa.RecordBatch.from_arrays([*columns, *own_columns], names=out_names)

    return rows.mapInArrow(lean("pii", run), schema)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, count_col="n_entities", kinds_col="kinds")


QUERIES = {"op5_pii_surrogates": op5_pii_surrogates}
ORACLE_SQL: dict[str, str] = {}
