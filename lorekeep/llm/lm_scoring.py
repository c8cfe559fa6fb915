"""Scores of texts by online logistic context mixing over token statistics of the training documents.

A token is told in binary decisions: whether it is one that training never showed; if so, the bits of its bytes
(``spelling.py``); if not, the three bits of its class (eight classes by hash), the band of its frequency in the class, and its place
in the band, bit by bit. All go through the mixer. Class bits are predicted by the class frequencies of the corpus, by what followed
the token before and the one two before in training (tables hashed by token, gathered from all training documents), and by what the
document itself has shown so far, alone and by a hash of the token before; the other bits by the shares of the corpus and by what the document
has shown at the same node, alone and behind the same token before; these are counted, exactly, before documents learn. The predictions are mixed in the logistic domain by
weights that a gate selects (how often the token before was seen, or the node), the result is refined by an adaptive map, and weights and
map learn from every decision. Documents learn apart from each other, each from its first token to its last, side by side in numpy; one of
over 1,024 tokens learns after every few.

The statistics are exact. Blocks ask buckets about their distinct tokens; so they grow with the corpus
and no task or driver holds them all. The driver gets some hundred sums for every bucket (8 MB of text) and at most 3.2 million counts of
bytes behind bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorekeep.llm import blocks as B
from lorekeep.llm.hashing import mix64, span_hashes, word_bounds
from lorekeep.llm.spelling import DEEPER, Letters, letter_contexts, letter_pairs, letters, spelled
from lorekeep.session import materialise

ADD = 0.1
CLASSES, LEVELS = 8, 3
# Bands of a class: words whose training counts have the same number of binary digits.
BANDS, BAND_LEVELS = 32, 5
CELLS = CLASSES * BANDS
_PIECE = 1 << 20
# Distinct tokens whose decisions are found at a time; documents, and about how many tokens, that learn side by side; about how many
# tokens are made ready for their steps at a time.
_PATHS, _LANES, _TOGETHER, _READY = 1 << 15, 4096, 1 << 20, 1 << 13
# About how many tokens' visits are counted at a time.
_COUNTED = 1 << 15
# Steps of a document: a longer text is told by as many tokens a step as that takes, up to so many, and learned from after every step. Maps learn by the mean of the tokens of a step, so that they stay chances; weights by at most four times the mean.
_STEPS, _MOST_A_STEP, _MOST_MEANS = 1 << 10, 100, 4
_END = np.uint64(0x0123456789ABCDEF)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
# Contexts of a decision, gates, slots of the document's own table, steps of the adaptive map.
_INPUTS, _GATES, _SLOTS, _MAP = 5, 4, 32, 17
_RATE, _MAP_RATE, _PRIOR = 0.02, 0.02, 2.0
# The same for the word within its class: predictions, prior of counts, and what counts stop at, from where on they are given in proportion.
_DEEP_INPUTS, _DEEP_PRIOR, _MOST = 3, 2.0, 60_000
# What is left of the code of a token when its bits are told.
_TOLD = np.uint64(1 << 63)
# Gates by how often the document came to the node (0 to 3) and did so behind the token before (0 to 2), and their first weights.
_DEEP_START = np.array([[(1.0, 0.0, 0.0), (0.3, 0.2, 0.6), (0.2, 0.2, 0.7)]] + [[(0.5, 0.5, 0.0), (0.2, 0.3, 0.6), (0.1, 0.3, 0.7)]] * 3).reshape(12, 3)
_DEEP_RATE, _REACH = 0.02, 12.0
# Node of each class on each level of the tree, and the bit taken there.
_CLASS = np.arange(CLASSES)
_NODE = np.stack([0 * _CLASS, 1 + (_CLASS >> 2), 3 + (_CLASS >> 1)], axis=1)
_BIT = np.stack([_CLASS >> 2, (_CLASS >> 1) & 1, _CLASS & 1], axis=1).astype(np.float32)


def held_out(ids: np.ndarray) -> np.ndarray:
    """Whether crc32 of the id as text leaves 0 modulo 10; a null id counts as the empty text."""
    names = ("" if x == B.NO_ID else str(x) for x in ids.tolist())
    return np.array([zlib.crc32(name.encode()) % 10 == 0 for name in names], bool)


class Tokens(NamedTuple):
    names: np.ndarray  # hashes of distinct tokens by bucket, then hash
    bucket: np.ndarray
    of: np.ndarray  # distinct token at every place
    doc: np.ndarray
    before: np.ndarray  # distinct token one and two places before; the end mark before a document begins
    earlier: np.ndarray


def tokens(block: B.Block, buckets: int) -> Tokens:
    """Words with A-Z in lower case and an end after each document."""
    texts = [text.lower() for text in block.texts()]
    n = len(texts)
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    at = 0
    while at < n:
        # Hashing takes many times the memory of its texts: about a megabyte at a time.
        upto, size = at + 1, len(texts[at])
        while upto < n and size + len(texts[upto]) <= _PIECE:
            size += len(texts[upto])
            upto += 1
        piece = texts[at:upto]
        data = np.frombuffer(b"\n".join([*piece, b""]), np.uint8)
        starts, ends = word_bounds(data)
        places = np.cumsum([len(text) + 1 for text in piece]) - 1
        parts.append((span_hashes(data, starts, ends), np.searchsorted(places, starts, side="right") + at))
        at = upto
    names, doc = map(np.concatenate, zip(*parts))
    # The end of a document comes last.
    words = np.bincount(doc, minlength=n)
    ends = np.cumsum(words + 1) - 1
    whole = np.full(len(names) + n, _END)
    within = np.ones(len(whole), bool)
    within[ends] = False
    whole[within] = names
    doc = np.repeat(np.arange(n), words + 1)
    # By a table of hashes: fewer distinct tokens than tokens are sorted.
    found = pa.array(whole).dictionary_encode()
    distinct, of = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct, of = distinct[order], rank[of]
    # Ranges of hashes, so that the order of all tokens does not depend on how many buckets there are.
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    end = of[-1] if len(of) else 0
    shifted = lambda k: np.where(np.concatenate([np.full(k, -1), doc[:-k]])[: len(doc)] == doc, np.concatenate([np.full(k, end), of[:-k]])[: len(of)], end)
    return Tokens(distinct, bucket, of, doc, shifted(1), shifted(2))


def _class(names: np.ndarray) -> np.ndarray:
    return (mix64(names) >> np.uint64(61)).astype(np.int64)


def _follows(rows: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """How often each class follows each of ``n`` tokens."""
    return np.bincount(rows * CLASSES + classes, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.uint32)


def _ask(block: B.Block, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket: token hashes, training counts, classes that followed one and two places on."""
    seen = tokens(block, buckets)
    n, training = len(seen.names), ~held_out(block.ids)[seen.doc]
    counts = np.bincount(seen.of[training], minlength=n).astype(np.uint32)
    classes = _class(seen.names)[seen.of][training]
    one = _follows(seen.before[training], classes, n)
    two = _follows(seen.earlier[training], classes, n)
    starts = np.flatnonzero(np.append(True, seen.bucket[1:] != seen.bucket[:-1])) if n else []
    for start, end in zip(starts, [*starts[1:], n]):
        part = slice(start, end)
        steps = np.diff(seen.names[part], prepend=np.uint64(0))
        yield int(seen.bucket[start]), B.squeezed(steps, counts[part], one[part].ravel(), two[part].ravel())


def _cell(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class and band of tokens with these training counts."""
    return _class(names) * BANDS + np.minimum(np.frexp(np.maximum(counts, 1))[1] - 1, BANDS - 1)


def _totals(asked: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names = [np.cumsum(steps, dtype=np.uint64) for steps, *_ in asked]
    distinct, of = np.unique(np.concatenate(names), return_inverse=True)
    counts = np.bincount(of, np.concatenate([x[1] for x in asked]), len(distinct))
    follows = []
    for at in (2, 3):
        rows = np.concatenate([x[at] for x in asked]).reshape(-1, CLASSES)
        follows.append(np.stack([np.bincount(of, rows[:, label], len(distinct)) for label in range(CLASSES)], axis=1))
    return np.split(of, np.cumsum([len(x) for x in names])[:-1]), distinct, counts, *follows


def _answer(asked: list[list[np.ndarray]]) -> list[bytes]:
    """For every token asked about: its totals, and its place among the bucket's trained tokens of its class and band.

    The first reply of a bucket adds the bucket's sums by class and band: tokens, distinct tokens, those seen once.
    """
    parts, distinct, counts, one, two = _totals(asked)
    cells, trained = _cell(distinct, counts), counts > 0
    sums = [np.bincount(cells, x, CELLS) for x in (counts, trained, counts == 1)]
    # Tokens stand by hash, so a place within a cell does not depend on the blocks.
    order = np.argsort(np.where(trained, cells, CELLS), kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    place -= (np.cumsum(sums[1]) - sums[1]).astype(np.int64)[cells]
    place[~trained] = 0
    out = []
    for at, part in enumerate(parts):
        extra = np.concatenate(sums).astype(np.int64) if at == 0 else np.empty(0, np.int64)
        rows = [x[part].astype(np.uint32).ravel() for x in (counts, one, two)]
        out.append(B.squeezed(*rows, extra, place[part].astype(np.uint32)))
    return out


class Corpus(NamedTuple):
    """Sums over all training tokens: by class tokens, distinct tokens, those seen once; by class and band tokens and distinct
    tokens; and per bucket how many distinct tokens of each class and band are in the buckets before it."""

    tokens: np.ndarray
    distinct: np.ndarray
    once: np.ndarray
    mass: np.ndarray
    size: np.ndarray
    before: np.ndarray


def _summed(replies: DataFrame, buckets: int) -> Corpus:
    """The driver gets the sums of every bucket by class and band, some hundred numbers for 8 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(bucket, B.unsqueezed(load)[3]) for bucket, load in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist())]
            for bucket, sums in rows:
                places = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), bucket), pa.int64()), pa.array(places, pa.int64()), pa.array(sums[places], pa.int64())],
                    names=["bucket", "at", "n"],
                )

    sums = replies.select("bucket", "payload").mapInArrow(run, "bucket long, at long, n long").toArrow()
    total = np.zeros((buckets, 3 * CELLS), np.int64)
    total[sums.column("bucket").to_numpy(), sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    held = total[:, CELLS : 2 * CELLS]
    mass, size, once = total.sum(axis=0).reshape(3, CELLS).astype(float)
    by_class = lambda x: x.reshape(CLASSES, BANDS).sum(axis=1)
    return Corpus(by_class(mass), by_class(size), by_class(once), mass, size.astype(np.int64), np.cumsum(held, axis=0) - held)


def _letters(blocks: DataFrame) -> Letters:
    """Counts of bytes behind one, two and three bytes over all training texts, summed up per task and then by place."""
    size = (1 << 16) + 256 * sum(DEEPER)

    def count(part: list[bytes], total: np.ndarray) -> None:
        text = b" ".join(part)
        total[: 1 << 16] += letter_pairs(text)
        total[1 << 16 :] += letter_contexts(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = B.opened(row)
                part, length = [], 0
                for text in compress(block.texts(), (~held_out(block.ids)).tolist()):
                    part.append(text.lower())
                    length += len(text)
                    if length > _PIECE:
                        count(part, total)
                        part, length = [], 0
                count(part, total)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(total[places], pa.int64())], names=["place", "n"])

    sums = blocks.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return letters(total[: 1 << 16], total[1 << 16 :])


def _spelled(block: B.Block, seen: Tokens, unseen: np.ndarray, known: Letters) -> np.ndarray:
    """Natural logs of the spellings of unseen tokens; nothing for others. An unseen end mark is an empty word."""
    logs = np.zeros(len(seen.of))
    docs = set(np.unique(seen.doc[unseen]).tolist())
    bounds = np.searchsorted(seen.doc, np.arange(len(block.ids) + 1))
    at, words = [], []
    for doc, text in enumerate(block.texts()):
        if doc in docs:
            mark = unseen[bounds[doc] : bounds[doc + 1]]
            found = [hit.group() for hit in compress(_WORD.finditer(text.lower()), mark[:-1].tobytes())]
            words.append(found + [b""] * bool(mark[-1]))
            at.append(bounds[doc] + np.flatnonzero(mark))
    for places, told in zip(at, spelled(words, known)):
        logs[places] = told
    return logs


def _tree(follows: np.ndarray) -> np.ndarray:
    """Counts at each of the seven nodes, above 32 bits of those that go right; in rows of eight, which come from memory at once."""
    quarters = follows.reshape(-1, 4, 2).sum(axis=2)
    halves = quarters.reshape(-1, 2, 2).sum(axis=2)
    out = np.zeros((len(follows), CLASSES), np.int64)
    out[:, 0] = halves.sum(axis=1)
    out[:, 1:3], out[:, 3:7] = halves, quarters
    out <<= 32
    out[:, 0] += halves[:, 1].astype(np.int64)
    out[:, 1:3] += quarters[:, 1::2].astype(np.int64)
    out[:, 3:7] += follows[:, 1::2].astype(np.int64)
    return out


def _split(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands above 32 bits and what below, in single precision."""
    return (counts >> 32).astype(np.float32), (counts & 0xFFFFFFFF).astype(np.float32)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


class Paths(NamedTuple):
    """The decisions that tell distinct tokens within their classes, one token after the other."""

    start: np.ndarray
    length: np.ndarray
    code: np.ndarray  # bits of each token, from the highest on, and a set bit that ends them
    signed: np.ndarray  # chance of a set bit in the corpus, in single precision; negative where the bit is not set
    rest: np.ndarray  # log of the chance of this and all later bits of the token in the corpus

    @property
    def bit(self) -> np.ndarray:
        return (self.signed > 0).astype(np.uint8)

    @property
    def prior(self) -> np.ndarray:
        return np.abs(self.signed)


def paths(names: np.ndarray, counts: np.ndarray, ranks: np.ndarray, corpus: Corpus) -> Paths:
    """Band by the band's share of its class, then the place in the band, of which each is as likely: no token is left out
    and none is told in two ways, so the chances of a class's tokens make one. Decisions that have no choice are left out.

    ``ranks`` are the places of tokens among all of their class and band; tokens that training never showed have no decisions.
    """
    # Finding the decisions takes several times the memory of what is kept of them: some thousand tokens at a time.
    parts = [_paths(*(x[at : at + _PATHS] for x in (names, counts, ranks)), corpus) for at in range(0, max(len(names), 1), _PATHS)]
    length, code, signed, rest = (np.concatenate(column) for column in zip(*parts))
    return Paths(np.cumsum(length) - length, length, code, signed, rest)


def _paths(names: np.ndarray, counts: np.ndarray, ranks: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, ...]:
    n = len(names)
    cells = _cell(names, counts)
    label, band, size = cells // BANDS, cells % BANDS, corpus.size[cells]
    mass = corpus.mass.reshape(CLASSES, BANDS)
    trained = np.flatnonzero(counts > 0)
    deep = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    length, code = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    parts = []
    for level in range(BAND_LEVELS + int(deep[trained].max(initial=0))):
        if level < BAND_LEVELS:
            sums = mass.reshape(CLASSES, 2 << level, -1).sum(axis=2)
            at, bit = band[trained] >> (BAND_LEVELS - level), (band[trained] >> (BAND_LEVELS - 1 - level)) & 1
            left, right = sums[label[trained], 2 * at], sums[label[trained], 2 * at + 1]
            token = trained
        else:
            step = deep - (level - BAND_LEVELS)
            token = trained[step[trained] > 0]
            half, rank, all_ = 1 << (step[token] - 1), ranks[token], size[token]
            above = rank & -2 * half
            bit = (rank & half > 0).astype(np.int64)
            left, right = np.clip(all_ - above, 0, half), np.clip(all_ - above - half, 0, half)
        choice = np.flatnonzero((left > 0) & (right > 0))
        token, bit, left, right = token[choice], bit[choice], left[choice], right[choice]
        # A chance that single precision takes for none or one stays a chance.
        chance = np.clip((right / (left + right)).astype(np.float32), np.float32(2.0**-24), np.float32(1 - 2.0**-24))
        parts.append((token.astype(np.uint16), np.where(bit > 0, chance, -chance)))
        code[token] |= bit.astype(np.uint64) << (np.uint64(63) - length[token].astype(np.uint64))
        length[token] += 1
    code |= np.uint64(1) << (np.uint64(63) - length.astype(np.uint64))
    token, signed = map(np.concatenate, zip(*parts))
    signed = signed[np.argsort(token, kind="stable")]
    logs = np.log(np.where(signed > 0, signed, 1 + signed)).astype(np.float64)
    sums = np.cumsum(logs)
    ends = np.cumsum(length)
    rest = np.repeat(np.append(0, sums)[ends], length) - sums + logs
    return length, code, signed, rest.astype(np.float32)


def _visits(key: np.ndarray, code: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """How often each decision came before, above 16 bits of how often its bit was set then, among the tokens of the same ``key``, which
    stand in their order; to ``at`` and on, for the first and later decisions. Tokens are parted bit by bit and keep their order, so
    that those that share a decision stand together; what only one token comes to stays zero."""
    order = np.argsort(key, kind="stable")
    key, code, at = (x[order] for x in (key, code, at))
    del order
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    length = np.diff(np.append(begin, len(key)))
    while True:
        # A token alone, and one whose bits are all told, comes to no decision of others.
        stay = (length > 1) & (code[begin] != _TOLD)
        if not stay.all():
            each = np.flatnonzero(np.repeat(stay, length))
            code, at, length = code.take(each), at.take(each), length[stay]
            begin = np.cumsum(length) - length
        if not len(length):
            return
        place = np.arange(len(code))
        bit = (code >> np.uint64(63)).view(np.int64)
        ones = np.cumsum(bit)
        last = ones[begin + length - 1]
        ones -= bit
        base = ones[begin]
        total = last - base
        ones -= np.repeat(base, length)
        came, shown = place - np.repeat(begin, length), ones
        if len(key) > _MOST:
            over = np.maximum(came, _MOST)
            came, shown = came * _MOST // over, ones * _MOST // over
        came <<= 16
        came += shown
        out[at] = came.astype(np.uint32)
        goes = np.where(bit > 0, np.repeat(begin + length - total, length) + ones, place - ones)
        code <<= np.uint64(1)
        at += 1
        moved = np.empty_like(code), np.empty_like(at)
        moved[0][goes], moved[1][goes] = code, at
        code, at = moved
        length = np.stack([length - total, total], axis=1).ravel()
        length = length[length > 0]
        begin = np.cumsum(length) - length


def _bend(dot: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-dot))


def _fixed(classes: np.ndarray, training: np.ndarray, prior: np.ndarray, tables) -> np.ndarray:
    """What corpus and training contexts say of the class bits, in the logistic domain; by prediction, and by token and level."""
    node = np.take(_NODE, classes, axis=0)
    out = training.astype(np.float32)[:, None]
    set_ = (out * np.take(_BIT, classes, axis=0)).ravel()
    out = np.repeat(out, LEVELS)
    p0 = prior.take(node.ravel())
    x = np.empty((1 + len(tables), node.size), np.float32)
    x[0] = _logit(prior).take(node.ravel())
    more, less = np.float32(_PRIOR) * p0, np.float32(_PRIOR) * (1 - p0)
    for column, (row, counts) in enumerate(tables, 1):
        c, r = _split(counts.take((node + (row * counts.shape[1])[:, None]).ravel()))
        c -= out
        np.maximum(c, 0, out=c)
        r -= set_
        np.clip(r, 0, c, out=r)
        c -= r
        c += less
        r += more
        r /= c
        np.log(r, out=x[column])
    return x


def mixed(
    seen: Tokens, classes: np.ndarray, known: np.ndarray, training: np.ndarray, one: np.ndarray, two: np.ndarray,
    corpus: Corpus, inner: Paths,
) -> np.ndarray:
    """Natural log of the probability of every token's decisions.

    ``training`` marks tokens that the statistics contain; of the classes they are taken out of what predicts them. Documents
    go side by side, each from its first token to its last.
    """
    n = len(seen.of)
    result = np.zeros(n)
    if not n:
        return result
    after1, after2 = _tree(one), _tree(two)
    quarters = corpus.tokens.reshape(4, 2).sum(axis=1)
    halves = quarters.reshape(2, 2).sum(axis=1)
    everything, rightwards = np.hstack([halves.sum(), halves, quarters]), np.hstack([halves[1], quarters[1::2], corpus.tokens[1::2]])
    prior = ((rightwards + 0.5) / (everything + 1.0)).astype(np.float32)
    total = corpus.tokens.sum()
    fresh = min(0.5, (corpus.once.sum() + 0.5) / (total + 1.0))
    start = np.flatnonzero(np.append(True, seen.doc[1:] != seen.doc[:-1]))
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    slot_of = (mix64(seen.names) % np.uint64(_SLOTS)).astype(np.int64)
    gate_of = np.minimum(np.log2(1 + (after1[:, 0] >> 32)) / 3, _GATES - 1).astype(np.int64)
    tables = ((seen.before, after1), (seen.earlier, after2))
    # Documents of like length go together, few enough that their tables stay small and near.
    group = np.cumsum(length) // _TOGETHER + np.arange(len(length)) // _LANES
    for lanes in np.split(np.arange(len(length)), np.flatnonzero(np.diff(group)) + 1):
        places, lane, before, begin = _steps(start[lanes], length[lanes])
        # Where the tokens of a document stand less where they stand in their block, with one document after the other.
        behind = np.cumsum(length[lanes]) - length[lanes] - start[lanes]
        alone = slice(int(start[lanes[0]]), int(start[lanes[0]] + length[lanes[0]]))
        whole = np.arange(len(places)) - np.repeat(behind, length[lanes]) if len(lanes) > 1 else alone
        word = _Words(inner, length[lanes], *(x[whole] for x in (seen.of, known, classes, seen.before)))
        novel, bits = _Novelty(len(lanes), fresh), _Classes(len(lanes))
        first, steps = 0, len(begin) - 1
        while first < steps:
            last = max(first + 1, int(np.searchsorted(begin, begin[first] + _READY, side="right")) - 1)
            now = slice(begin[first], begin[last])
            at, of = places[now], lane[now]
            left, told = seen.before[at], known[at]
            fixed = _fixed(classes[at], training[at], prior, [(row[at], counts) for row, counts in tables])
            share = 1 / _together(length[lanes])[of].astype(np.float32)
            novel.ready(of, before[now], told, gate_of[left], _boosted(share))
            bits.ready(of, classes[at], told, fixed, prior, slot_of[left], gate_of[left], share)
            ends = word.ready(of, at + behind[of], seen.of[at], told, share)
            bounds = (begin[first : last + 1] - begin[first]).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                result[at[a:b]] = novel.step(a, b) + bits.step(a, b) + word.step(a, b, ends[a], ends[b])
            first = last
    return result


def _together(length: np.ndarray) -> np.ndarray:
    return np.minimum(-(-length // _STEPS), _MOST_A_STEP)


def _boosted(share: np.ndarray) -> np.ndarray:
    return np.minimum(_MOST_MEANS * share, np.float32(1))


def _steps(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places and lanes of all tokens in the order of their steps, the tokens told in the steps before, and where each step begins."""
    lane = np.repeat(np.arange(len(length)), length)
    within = np.arange(len(lane)) - np.repeat(np.cumsum(length) - length, length)
    together = _together(length)[lane]
    step = within // together
    order = np.argsort(step.astype(np.min_scalar_type(int(step.max()))), kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(step)))
    return (start[lane] + within)[order], lane[order], (step * together)[order], begin


def _map_step(dot: np.ndarray) -> np.ndarray:
    return (np.minimum(np.maximum(2 * dot, -(_MAP // 2)), _MAP // 2) + (_MAP // 2 + 0.5)).astype(np.int64)


_CENTRES = ((np.arange(_MAP) - _MAP // 2) / 2.0).astype(np.float32)


class _Novelty:
    """Whether training never showed a token, by how often that was so in the document, weighed by the gate."""

    def __init__(self, lanes: int, fresh: float):
        self.fresh, self.novel = fresh, np.zeros(lanes)
        self.weights = np.ones(lanes * _GATES)

    def ready(self, lane: np.ndarray, before: np.ndarray, told: np.ndarray, gate: np.ndarray, share: np.ndarray) -> None:
        """Tokens in the order of their steps, for the steps that follow, each with the number of those before."""
        self.lane, self.before, self.told, self.weight, self.rate = lane, before + 4.0, told, lane * _GATES + gate, _RATE * share

    def step(self, a: int, b: int) -> np.ndarray:
        told, lane, at = self.told[a:b], self.lane[a:b], self.weight[a:b]
        x = _logit((self.novel[lane] + 4 * self.fresh) / self.before[a:b])
        p = _bend(np.minimum(np.maximum(self.weights[at] * x, -20), 20))
        np.add.at(self.weights, at, self.rate[a:b] * (~told - p) * x)
        if not told.all():
            np.add.at(self.novel, lane[~told], 1.0)
        return np.log(np.where(told, 1 - p, p))


class _Classes:
    """The class bits of all documents side by side, by lane and level."""

    def __init__(self, lanes: int):
        each = lanes * _GATES * LEVELS
        self.weights = np.repeat(np.array([0.2, 0.5, 0.2, 0.1, 0.1], np.float32), each)
        self.column = np.arange(_INPUTS)[:, None] * each
        self.refine = np.tile(_bend(_CENTRES), lanes * LEVELS)
        # Left, above 32 bits of right, at the seven nodes, over the document and behind a hash of the token before.
        self.own = np.zeros(lanes * 7, np.int64)
        self.hashed = np.zeros(lanes * _SLOTS * 7, np.int64)

    def ready(self, lane, label, told, fixed, prior, slot, gate, share) -> None:
        """Tokens in the order of their steps, for the steps that follow."""
        level = np.arange(LEVELS)
        node, bit = np.take(_NODE, label, axis=0), np.take(_BIT, label, axis=0).ravel()
        each = np.repeat(told, LEVELS)
        self.bit, self.fixed, self.told = bit, fixed, told
        self.more = np.where(bit > 0, 1, 1 << 32) * each
        share = np.repeat(told * share, LEVELS)
        self.map_rate, self.rate = np.float32(_MAP_RATE) * share, np.float32(_RATE) * _boosted(share)
        self.right = np.float32(_PRIOR) * prior.take(node.ravel())
        self.left = np.float32(_PRIOR) - self.right
        self.at = [(node + (7 * of)[:, None]).ravel() for of in (lane, lane * _SLOTS + slot)]
        self.weight = (((lane * _GATES + gate) * LEVELS)[:, None] + level).ravel()
        self.map = (((lane * LEVELS)[:, None] + level) * _MAP).ravel()

    def step(self, a: int, b: int) -> np.ndarray:
        part = slice(LEVELS * a, LEVELS * b)
        bit, more, right, left = self.bit[part], self.more[part], self.right[part], self.left[part]
        x = np.empty((_INPUTS, len(bit)), np.float32)
        x[: len(self.fixed)] = self.fixed[:, part]
        for column, (table, at) in enumerate(zip((self.own, self.hashed), self.at), len(self.fixed)):
            at = at[part]
            mine = table.take(at)
            np.add.at(table, at, more)
            rest, odds = _split(mine)
            rest += left
            odds += right
            odds /= rest
            np.log(odds, out=x[column])
        at = (self.weight[part] + self.column).ravel()
        dot = (self.weights.take(at).reshape(x.shape) * x).sum(axis=0)
        np.clip(dot, -_REACH, _REACH, out=dot)
        p = _bend(dot)
        step = self.map[part] + _map_step(dot)
        table = self.refine.take(step)
        mean = np.float32(0.75) * p + np.float32(0.25) * table
        np.add.at(self.refine, step, self.map_rate[part] * (bit - table))
        x *= self.rate[part] * (bit - p)
        np.add.at(self.weights, at, x.ravel())
        logs = np.log(np.abs(mean - (1 - bit)))
        return self.told[a:b] * sum(logs[level::LEVELS] for level in range(LEVELS))


class _Words:
    """The decisions within classes, of all documents side by side: chances in the corpus, what the document has shown at the node,
    and there behind the token before, mixed by gated weights and refined by a map; all learn from every decision at a node that the
    document has come to before. At any other all predictions are the chance in the corpus, which then holds as it is."""

    def __init__(self, inner: Paths, length: np.ndarray, token: np.ndarray, known: np.ndarray, classes: np.ndarray, before: np.ndarray):
        """Tokens one document after the other; those that are not ``known`` have no decisions."""
        lanes, gates = len(length), len(_DEEP_START)
        self.inner = inner
        size = (inner.length[token] * known).astype(np.uint8)
        ends = np.cumsum(size, dtype=np.int64)
        self.begin, self.been = ends - size, np.zeros(len(size), np.uint8)
        # What a document has shown does not depend on what was learned, so it is counted before, for some documents at a time.
        self.marks = [np.zeros(int(ends[-1]), np.uint32) for _ in range(2)]
        ends = np.cumsum(length)
        for docs in np.split(np.arange(lanes), np.flatnonzero(np.diff(ends // _COUNTED)) + 1):
            part = slice(int(ends[docs[0]] - length[docs[0]]), int(ends[docs[-1]]))
            told, lane = part.start + np.flatnonzero(size[part]), np.repeat(np.arange(len(docs)), length[docs])
            # Classes have no node in common: of a long text they are counted one by one.
            apart = len(told) > 4 * _COUNTED
            for mine in [told[classes[told] == label] for label in range(CLASSES)] if apart else [told]:
                of, word, label = lane[mine - part.start], token[mine], classes[mine]
                for key, out in zip((of, of * len(inner.length) + before[mine]), self.marks):
                    key = key * CLASSES + label
                    if len(key) and key.max() < 1 << 16:
                        key = key.astype(np.uint16)
                    _visits(key, inner.code[word], self.begin[mine], out)
            # The document came to a node only if it came to those above.
            if len(told):
                first, last = int(self.begin[told[0]]), int(self.begin[told[-1]]) + int(size[told[-1]])
                self.been[told] = np.add.reduceat(self.marks[0][first:last] > 0, self.begin[told] - first, dtype=np.uint8)
        self.weights = [np.tile(_DEEP_START[:, column].astype(np.float32), lanes) for column in range(_DEEP_INPUTS)]
        self.refine = np.tile(_bend(_CENTRES), lanes * gates)

    def ready(self, of: np.ndarray, at: np.ndarray, token: np.ndarray, known: np.ndarray, share: np.ndarray) -> list[int]:
        """Tokens in the order of their steps, for the steps that follow, and where they stand among all; the result tells where the
        decisions that are mixed begin of each. Those at other nodes are told here."""
        inner, size = self.inner, self.been[at].astype(np.int64)
        ends = np.cumsum(size)
        before, start = ends - size, inner.start[token]
        # All later decisions of a token, if any, are at nodes that the document comes to for the first time.
        self.plain = np.zeros(len(token))
        more = np.flatnonzero((size < inner.length[token]) & known)
        self.plain[more] = inner.rest[(start + size)[more]]
        mine = np.repeat(np.arange(len(token)), size)
        place = np.arange(len(mine))
        marks = place + (self.begin[at] - before).take(mine)
        signed = inner.signed.take(place + (start - before).take(mine))
        chance = np.abs(signed)
        gate = (of * len(_DEEP_START)).take(mine)
        self.unset, self.x = (signed < 0).astype(np.float32), [np.log(chance / (1 - chance))]
        for most, weight, mark in zip((3, 2), (3, 1), self.marks):
            mark = mark.take(marks)
            total = mark >> np.uint32(16)
            ones = (mark & np.uint32(0xFFFF)).astype(np.float32)
            chance *= np.float32(_DEEP_PRIOR)
            ones += chance
            whole = total.astype(np.float32)
            whole += np.float32(_DEEP_PRIOR)
            chance = ones / whole
            whole -= ones
            ones /= whole
            self.x.append(np.log(ones, out=ones))
            gate += np.minimum(total, np.uint32(most)) * np.uint32(weight)
        self.token, self.gate, self.map = mine, gate, gate * _MAP
        self.rate, self.map_rate = (np.float32(_DEEP_RATE) * _boosted(share)).take(mine), (np.float32(_MAP_RATE) * share).take(mine)
        return [0, *ends.tolist()]

    def step(self, a: int, b: int, first: int, last: int) -> np.ndarray:
        """Logs of the tokens from ``a`` on, whose mixed decisions begin at ``first``."""
        if first == last:
            return self.plain[a:b]
        part = slice(first, last)
        gate, unset, x = self.gate[part], self.unset[part], [column[part] for column in self.x]
        dot = self.weights[0].take(gate)
        dot *= x[0]
        for column in range(1, _DEEP_INPUTS):
            more = self.weights[column].take(gate)
            more *= x[column]
            dot += more
        np.clip(dot, -_REACH, _REACH, out=dot)
        p = _bend(dot)
        step = self.map[part] + _map_step(dot)
        table = self.refine.take(step)
        mean = np.float32(0.75) * p + np.float32(0.25) * table
        bit = 1 - unset
        miss = self.rate[part] * (bit - p)
        for column in range(_DEEP_INPUTS):
            np.add.at(self.weights[column], gate, miss * x[column])
        np.add.at(self.refine, step, self.map_rate[part] * (bit - table))
        mean -= unset
        return self.plain[a:b] + np.bincount(self.token[part] - a, np.log(np.abs(mean, out=mean), out=mean), b - a)


_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, bits_per_byte double"
)


def _finish(block: B.Block, got: dict, buckets: int, corpus: Corpus, known: Letters) -> pa.Table:
    seen = tokens(block, buckets)
    n = len(seen.names)
    counts, ranks = np.zeros(n), np.zeros(n, np.int64)
    one, two = np.zeros((n, CLASSES), np.float32), np.zeros((n, CLASSES), np.float32)
    starts = np.flatnonzero(np.append(True, seen.bucket[1:] != seen.bucket[:-1])) if n else []
    for start, end in zip(starts, [*starts[1:], n]):
        c, first, second, _, place = B.unsqueezed(got[0, int(seen.bucket[start])])
        counts[start:end], one[start:end], two[start:end] = c, first.reshape(-1, CLASSES), second.reshape(-1, CLASSES)
        ranks[start:end] = place
    ranks += corpus.before[seen.bucket, _cell(seen.names, counts)]
    held = held_out(block.ids)
    c, label = counts[seen.of], _class(seen.names)[seen.of]
    total, distinct = corpus.tokens.sum(), corpus.distinct.sum()
    base = np.log10((c + ADD) / (total + ADD * (distinct + 1)))
    # A known token is told bit by bit to the end; one that training never showed is spelled.
    logs = mixed(seen, label, c > 0, ~held[seen.doc], one, two, corpus, paths(seen.names, counts, ranks, corpus))
    logs += _spelled(block, seen, c == 0, known)
    docs = len(block.ids)
    by_doc = lambda x: np.bincount(seen.doc, x, docs) if len(seen.doc) else np.zeros(docs)
    score = by_doc(logs) / np.log(10)
    n_bytes = np.maximum(np.diff(block.bounds), 1)
    return pa.table(
        {
            "doc_id": B.id_column(block.ids),
            "held_out": pa.array(held),
            "n_tokens": pa.array(by_doc(None).astype(np.int64)),
            "n_known": pa.array(by_doc((c > 0).astype(float)).astype(np.int64)),
            "train_tokens": pa.array(np.full(docs, int(total)), pa.int64()),
            "base_score": pa.array(by_doc(base)),
            "score": pa.array(score),
            "bits_per_byte": pa.array(-score * np.log2(10) / n_bytes),
        }
    )


def lm_scores(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The contract's columns and ``bits_per_byte`` per row of ``docs`` (``doc_id, text``).

    Null and empty texts are an end mark alone (their bits are given for one byte). A null id counts as the empty text
    when rows are held out. Rows that repeat are trained on and scored one by one. Without training
    documents every token is unseen and spelled. Empty input gives no rows. Other columns are left behind.
    """
    blocks = B.packed(docs, block_bytes)
    buckets = B.bucket_count(blocks, block_bytes)
    # Read for the sums and by the blocks.
    replies = materialise(B.answered(B.asked(blocks, lambda block: _ask(block, buckets)), _answer, kind=0))
    corpus, known = _summed(replies, buckets), _letters(blocks)
    return B.finished(blocks, replies, lambda block, got: _finish(block, got, buckets, corpus, known), _SCHEMA)
