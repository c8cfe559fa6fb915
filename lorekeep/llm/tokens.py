"""Token counts by a compiled byte-pair tokenizer.

A vocabulary with merges becomes a deterministic transducer over bytes. Its state after a prefix holds, for
every place from which a vocabulary entry may still run on, the entry's place in the trie, the token that
ends there and the tokens counted since: all that later bytes depend on. A transition is annotated with
the number of tokens by which the count changes. States are made when a text first needs them.

The words that the pre-tokenizer cuts can be counted alone. A cut is certain before white space that
follows something else, so a text falls into segments, and a chunk of a text into a head up to its first certain cut, a
count, and a tail behind its last one. Such maps compose; a prefix scan over the chunks of a
long text gives the count up to every chunk.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import map_rows

LIMIT = 512
CHUNK = 1 << 16
# Segments and states that are remembered; beyond that a table starts anew.
REMEMBERED, STATES = 300_000, 200_000
# White space in the tokenizer's sense: fixed values.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENTS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CUT = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies spell each byte: printable Latin-1 stands for itself, the rest follows."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(byte): byte for byte in plain}
    return letters | {chr(256 + at): byte for at, byte in enumerate(b for b in range(256) if b not in plain)}


class Transducer:
    """Counts the tokens of one word (bytes)."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> None:
        self.merges = merges
        # How each token is made: rank of its merge, left and right part. Bytes are made before all merges.
        self.made = {entry: (-1, entry, entry) for entry in ids if len(entry) == 1}
        for (one, two), rank in merges.items():
            self.made.setdefault(one + two, (rank, one, two))
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for entry in ids:
            node = 0
            for byte in entry:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][byte]
            self.token[node] = entry
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.restart()

    def restart(self) -> None:
        start = ((0, None, 0),)
        self.numbers, self.states, self.steps = {start: 0}, [start], [{}]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours; a sequence is right if all its neighbours are.

        Both are taken apart from the outside, latest merge first. If at some moment the parts that touch
        have a merge that comes before the next one of their own, it would have been made across the border.
        Of equal ranks the left one is made first.
        """
        key = left, right
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) > 4 * STATES:
            self.pairs.clear()
        before, found = 1 << 60, True
        while True:
            if self.merges.get((left, right), 1 << 60) < before:
                found = False
                break
            (of_left, _, inner_left), (of_right, inner_right, _) = self.made[left], self.made[right]
            if max(of_left, of_right) < 0:
                break
            if of_left > of_right:
                before, left = of_left, inner_left
            else:
                before, right = of_right + 1, inner_right
        self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the tokens that the count changes by."""
        live, ends = [], []
        for node, left, since in self.states[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and (left is None or self.fits(left, token)):
                ends.append((token, 1 - since))
            if self.trie[child]:
                live.append((child, left, since))
        # Exactly one token can end here; single bytes are in the vocabulary.
        token, change = ends[0]
        # Where the count went up by ``change``, so did the distance to every earlier place.
        target = (*((node, left, since + change) for node, left, since in live), (0, token, 0))
        if target not in self.numbers:
            self.numbers[target] = len(self.states)
            self.states.append(target)
            self.steps.append({})
        found = self.steps[state][byte] = self.numbers[target], change
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.restart()
        state, total, steps = 0, 0, self.steps
        for byte in word:
            found = steps[state].get(byte) or self.step(state, byte)
            state = found[0]
            total += found[1]
        return total


class Counter:
    """Token counts of texts under a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        letters = byte_letters()
        spell = lambda entry: bytes(letters[letter] for letter in entry)
        self.special = [entry["content"] for entry in spec["added_tokens"]]
        ids = {spell(e): at for e, at in spec["model"]["vocab"].items() if e not in self.special}
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"])
        merges = {(spell(one), spell(two)): rank for rank, (one, two) in enumerate(pairs)}
        self.machine = Transducer(ids, merges)
        # The pre-tokenizer's pattern: fixed.
        self.words = regex.compile(
            rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        )
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}
        self.counts: dict[str, int] = {}

    def segment(self, text: str) -> int:
        found = self.known.get(text)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = 0
            for word in self.words.findall(text):
                n = self.counts.get(word)
                if n is None:
                    if len(self.counts) > REMEMBERED:
                        self.counts.clear()
                    n = self.machine.count(word.encode())
                    if len(word) <= 64:
                        self.counts[word] = n
                found += n
            if len(text) <= 64:
                self.known[text] = found
        return found

    def between(self, text: str) -> int:
        """Tokens of a text that begins and ends at a certain cut."""
        if "  " in text:
            parts = _SEGMENTS.findall(text)
        else:
            # Without two spaces in a row, every space begins a segment.
            first, *rest = text.split(" ")
            parts = [first, *[" " + part for part in rest]]
        known = self.known
        total = 0
        for part in parts:
            found = known.get(part)
            total += self.segment(part) if found is None else found
        return total

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """``head, count, tail``; without a certain cut inside all is head and the count None."""
        first = _CUT.search(text)
        if first is None:
            return text, None, ""
        last = first.start()
        # The last cut is looked for from the end, in growing reaches.
        reach = 256
        while True:
            begin = max(first.start(), len(text) - reach)
            cuts = [cut.start() for cut in _CUT.finditer(text, begin)]
            if cuts or begin == first.start():
                last = cuts[-1] if cuts else last
                break
            reach *= 4
        return text[: first.start()], self.between(text[first.start() : last]), text[last:]

    def compose(self, one: tuple[str, int | None, str], two: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of both chunks in a row; associative."""
        if one[1] is None:
            joint = self.chunk(one[0] + two[0])
            if two[1] is None:
                return joint
            if joint[1] is None:
                return joint[0], two[1], two[2]
            return joint[0], joint[1] + self.between(joint[2]) + two[1], two[2]
        joint = self.chunk(one[2] + two[0])
        if joint[1] is None:
            if two[1] is None:
                return one[0], one[1], joint[0]
            return one[0], one[1] + self.between(joint[0]) + two[1], two[2]
        inner = one[1] + self.between(joint[0]) + joint[1]
        if two[1] is None:
            return one[0], inner, joint[2]
        return one[0], inner + self.between(joint[2]) + two[1], two[2]

    def scan(self, maps: list) -> list:
        """All prefixes of ``maps`` composed, by doubling."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[at - step], x) if at >= step else x for at, x in enumerate(maps)]
            step *= 2
        return maps

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if len(text) <= CHUNK:
            return self.between(text) if text else 0
        chunks = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]
        # Cuts beside the chunk ends are found where maps meet, since each fragment is looked at again there.
        head, count, tail = self.scan(list(map(self.chunk, chunks)))[-1]
        return self.between(head) + (count or 0) + (self.between(tail) if tail else 0)

    def count(self, text: str | None) -> int:
        """All tokens; special strings inside the text are one each."""
        if not text:
            return 0
        if not any(special in text for special in self.special):
            return self.plain(text)
        parts = self.split.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, compiled once per process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs`` (``doc_id, text``).

    ``path`` names a byte-level tokenizer file that every executor has. Null and empty texts have no
    bytes and no tokens. Rows that repeat are counted one by one. Empty input gives no rows. Other columns
    are left behind.
    """

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        tokens = list(map(counter(path).count, texts))
        yield {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(text.encode()) if text else 0 for text in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", "text"), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", step
    )
