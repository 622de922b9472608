"""A byte-level BPE vocabulary read from its JSON file: splitting into words, exact merges, ids to bytes.

Words are merged by tiktoken's rank merge. It joins any neighbours whose joined bytes are in the
vocabulary, lowest rank first, where the JSON file lists the pairs to join. Both give the same ids if
each vocabulary entry is what its own bytes merge to and ids rise with merge ranks (induction over
ranks: before rank r both hold the same pieces); `Vocabulary.check` tests that, and the tests call it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import regex
import tiktoken

from docloom.llm.common import cached

#: Fixed value: the pattern by which byte-level BPE of this family cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WORDS = regex.compile(PATTERN)

#: A place where words never join: a space character after another character.
CUT = regex.compile(r"(?<=\S)(?=\s)")
LAST_CUT = regex.compile(r"(?r)(?<=\S)(?=\s)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the JSON file: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for b in (b for b in range(256) if b not in set(plain)):
        letters[chr(256 + len(letters) - len(plain))] = b
    return letters


class Vocabulary:
    """ids: bytes to id; pieces: id to bytes; special: string to id."""

    def __init__(self, payload: bytes):
        model = json.loads(payload)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items()}
        self.merges = [tuple(bytes(letters[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]
        self._ranks = {pair: i for i, pair in enumerate(self.merges)}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.pieces = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece
        names = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self._special = regex.compile(f"({names})") if names else None

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings; these stand at the odd places."""
        return self._special.split(text) if self._special else [text]

    def slow_merge(self, word: bytes) -> list[int]:
        """The merges in the order of the file, one at a time: what `merge` has to equal."""
        ranks, parts = self._ranks, [bytes([b]) for b in word]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                return [self.ids[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def check(self) -> bool:
        """Whether rank merges and listed merges agree on any word: see the module's text."""
        ids = [self.ids[a + b] for a, b in self.merges]
        return ids == sorted(ids) and all(self.slow_merge(k) == [v] for k, v in self.ids.items())


@cached("bpe", "token_counts", size=2)
def vocabulary(payload: bytes) -> Vocabulary:
    return Vocabulary(payload)


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut only where words never join; a piece is longer where no cut is near."""
    start = 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
