"""Probabilities of words that training never showed, byte by byte.

Every byte, and the space that ends a word, is told in eight binary decisions. Each is predicted by the bytes of all
training texts, alone and behind the byte before (and, where given, behind two and three, in tables by hash), and by what the unseen words of the same document have shown so far:
alone, behind one byte and behind two, in tables by hash. The predictions are mixed in the logistic domain by
weights that a gate selects (the place in the word). A word is predicted with the tables and weights that the words
before it left, and then learned from as a whole; of a word of over ``PIECE`` bytes, so is every piece. In a document of very many
unseen words several are told, and then learned from, in one step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

PIECE = 64
# Steps of a document; with more pieces, several are told in a step, up to so many.
_STEPS, _MOST_A_STEP, _MOST_MEANS = 256, 16, 4
# Documents that learn side by side; each on its own tables and weights.
LANES = 256
_SPACE = 0x20
_ORDERS, _SLOT_BITS, _GATES = 3, 12, 4
_RATE, _PRIOR, _REACH = 0.001, 0.5, 20.0
_START = (0.0, 0.4, 0.1, 0.2, 0.3)
# Slots of the training texts' tables behind two and three bytes, the prior of their counts, and the weights with them.
DEEPER = (1 << 12, 1 << 13)
_DEEPER_PRIOR, _RARE = 4.0, 1e-6
_DEEPER_START = (0.0, 0.0, 0.2, 0.1, 0.1, 0.2, 0.4)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = bytes(_SPACE if at in (0x09, 0x0A, 0x0B, 0x0C, 0x0D) else at for at in range(256))
# Node of the tree over bytes on every level, and the bit taken there; node 1 is the root.
_BYTES = np.arange(256)[:, None]
_LEVEL = np.arange(8)[None, :]
NODE = (1 << _LEVEL) | (_BYTES >> (8 - _LEVEL))
BIT = ((_BYTES >> (7 - _LEVEL)) & 1).astype(np.float64)


def letter_pairs(text: bytes) -> np.ndarray:
    """How often each byte (in rows of 256) is followed by each; any white space is one space, also around the text."""
    data = np.frombuffer(b" " + text.translate(_BLANK) + b" ", np.uint8).astype(np.int32)
    counts = np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16)
    counts[_SPACE * 256 + _SPACE] = 0
    return counts


def _context(before: np.ndarray, earlier: np.ndarray, third: np.ndarray | None, slots: int) -> np.ndarray:
    """Slot of the two or three bytes before."""
    key = before.astype(np.uint64) | (earlier.astype(np.uint64) << np.uint64(8))
    if third is not None:
        key |= third.astype(np.uint64) << np.uint64(16)
    return ((key + np.uint64(1)) * _SPREAD >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


# What two bytes, and a third before them, add to the slot of a context, which is a sum modulo 2**64.
_TWO = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * _SPREAD
_THIRD = (np.arange(1 << 8, dtype=np.uint64) << np.uint64(16)) * _SPREAD


def letter_contexts(text: bytes) -> np.ndarray:
    """How often each byte follows each slot of two bytes, and then of three, in rows of 256. A word begins behind spaces alone, and
    no white space counts behind white space."""
    blank = text.translate(_BLANK)
    data = np.frombuffer(b"   " + blank + b" ", np.uint8)
    earlier, before, byte = data[1:-2], data[2:-1], data[3:]
    earlier = np.where(before == _SPACE, np.uint8(_SPACE), earlier)
    third = np.where(earlier == _SPACE, np.uint8(_SPACE), data[:-3])
    counted = (before != _SPACE) | (byte != _SPACE)
    before, earlier, third, byte = (x[counted] for x in (before, earlier, third, byte))
    two = _TWO[before | earlier.astype(np.uint16) << np.uint16(8)]
    sums = two, two + _THIRD[third]
    return np.concatenate(
        [
            np.bincount((x >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int32) * 256 + byte, minlength=slots * 256)
            for x, slots in zip(sums, DEEPER)
        ]
    )


class Letters(NamedTuple):
    """Chance of a set bit at each node, over all bytes and by the byte before; by the slots of two and of three bytes before,
    how often it was set and how often the node was reached."""

    alone: np.ndarray
    after: np.ndarray
    deeper: tuple[np.ndarray, ...] = ()


def letters(pairs: np.ndarray, contexts: np.ndarray | None = None) -> Letters:
    def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = np.concatenate([np.zeros_like(counts), counts], axis=-1)
        for level in range(7, -1, -1):
            first = 1 << level
            below[..., first : 2 * first] = below[..., 2 * first : 4 * first].reshape(*counts.shape[:-1], first, 2).sum(axis=-1)
        right = np.zeros_like(counts)
        right[..., 1:] = below[..., 3::2]
        return below[..., :256], right

    counts = pairs.reshape(256, 256).astype(np.float64)
    all_, right = tree(counts.sum(axis=0))
    alone = (right + 0.4) / (all_ + 0.8)
    all_, right = tree(counts)
    after = (right + 2 * alone) / (all_ + 2)
    deeper, at = [], 0
    for slots in DEEPER if contexts is not None else ():
        # In steps: the trees take several times the memory of the counts.
        counts = np.empty((slots, 256, 2), np.float32)
        for first in range(0, slots, 1024):
            part = contexts[at + first * 256 : at + min(first + 1024, slots) * 256].reshape(-1, 256).astype(np.float64)
            all_, right = tree(part)
            counts[first : first + 1024] = np.stack([right, all_], axis=-1)
        deeper.append(counts)
        at += slots * 256
    return Letters(alone, after, tuple(deeper))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _slots(before: np.ndarray, earlier: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of every decision in the table of each order."""
    contexts = np.stack([np.zeros_like(before), 1 + before, (1 + before) * 257 + earlier + 1], axis=-1)
    keys = (contexts[:, None, :] << 8) | node[:, :, None]
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _side_by_side(docs: list[list[bytes]], known: Letters) -> np.ndarray:
    """Natural logs of all words, document after document."""
    data = np.frombuffer(b"".join(word + b" " for words in docs for word in words), np.uint8)
    lengths = np.array([len(word) + 1 for words in docs for word in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    lane_of = np.repeat(np.arange(len(docs)), [len(words) for words in docs])
    pieces = -(-lengths // PIECE)
    word = np.repeat(np.arange(len(lengths)), pieces)
    inner = (np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    size = np.minimum(lengths[word] - inner, PIECE)
    lane = lane_of[word]
    together = np.minimum(-(-np.bincount(lane) // _STEPS), _MOST_A_STEP)
    rank = (np.arange(len(word)) - np.searchsorted(lane, lane)) // together[lane]
    order = np.lexsort((lane, rank))
    steps = np.append(np.searchsorted(rank[order], np.arange(rank.max() + 1)), len(order))

    weights = np.tile(np.array(_DEEPER_START if known.deeper else _START), (len(docs), _GATES, 1))
    tables = np.zeros((len(docs), _ORDERS, 1 << _SLOT_BITS, 2), np.float32)
    orders = np.arange(_ORDERS)[None, None, :]
    logs = np.zeros(len(lengths))
    for first, last in zip(steps[:-1], steps[1:]):
        now = order[first:last]
        of = np.repeat(np.arange(len(now)), size[now])
        place = inner[now][of] + np.arange(len(of)) - (np.cumsum(size[now]) - size[now])[of]
        at = starts[word[now]][of] + place
        mine = lane[now][of]
        # A word's first byte stands behind a space, its second behind that and a space.
        before = np.where(place > 0, data[np.maximum(at - 1, 0)], _SPACE).astype(np.int64)
        earlier = np.where(place > 1, data[np.maximum(at - 2, 0)], _SPACE).astype(np.int64)
        node, bit = NODE[data[at]], BIT[data[at]]
        slot = _slots(before, earlier, node)
        seen = tables[mine[:, None, None], orders, slot]
        behind = known.after[before[:, None], node]
        x = np.empty((len(at), 8, 2 + _ORDERS + len(known.deeper)))
        x[..., 0] = _logit(known.alone[node])
        x[..., 1] = _logit(behind)
        if known.deeper:
            third = np.where(place > 2, data[np.maximum(at - 3, 0)], _SPACE)
            for column, (table, byte) in enumerate(zip(known.deeper, (None, third)), 2 + _ORDERS):
                # Each context starts from what the shorter one says, and the document's own counts from the longest.
                counts = table[_context(before, earlier, byte, len(table))[:, None], node]
                behind = (counts[..., 0] + _DEEPER_PRIOR * behind) / (counts[..., 1] + _DEEPER_PRIOR)
                behind = np.minimum(np.maximum(behind, _RARE), 1 - _RARE)
                x[..., column] = _logit(behind)
        x[..., 2 : 2 + _ORDERS] = _logit((seen[..., 1] + _PRIOR * behind[..., None]) / (seen.sum(axis=-1) + _PRIOR))
        gate = np.minimum(place, _GATES - 1)
        p = 1 / (1 + np.exp(-np.clip((weights[mine, gate][:, None, :] * x).sum(axis=-1), -_REACH, _REACH)))
        told = np.log(np.where(bit > 0, p, 1 - p)).sum(axis=1)
        logs[word[now]] += np.bincount(of, told, len(now))
        # By the pieces of a step, but at most four times their mean.
        learned = (_RATE * np.minimum(_MOST_MEANS / together, 1))[mine, None] * ((bit - p)[:, None, :] @ x)[:, 0]
        inputs = weights.shape[2]
        at = ((mine * _GATES + gate) * inputs)[:, None] + np.arange(inputs)
        np.add.at(weights.reshape(-1), at.ravel(), learned.ravel())
        at = 2 * ((mine[:, None, None] * _ORDERS + orders << _SLOT_BITS) + slot) + bit.astype(np.int64)[..., None]
        np.add.at(tables.reshape(-1), at.ravel(), np.float32(1))
    return logs


def spelled(docs: list[list[bytes]], known: Letters) -> list[np.ndarray]:
    """Natural log of the probability of every word, and the space behind it, of each document.

    Words hold no white space and are told in order; an empty one is its space alone. Documents do not learn from each
    other. No document or one without words gives no numbers.
    """
    order = sorted(range(len(docs)), key=lambda at: -sum(-(-(len(word) + 1) // PIECE) for word in docs[at]))
    out = [np.zeros(0)] * len(docs)
    for first in range(0, len(order), LANES):
        group = [at for at in order[first : first + LANES] if docs[at]]
        if group:
            parts = np.split(_side_by_side([docs[at] for at in group], known), np.cumsum([len(docs[at]) for at in group])[:-1])
            for at, part in zip(group, parts):
                out[at] = part
    return out
