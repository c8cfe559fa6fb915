"""Repeated passages by a distributed merge sort of suffixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Not every suffix is sorted. Every window of ``LENGTH`` bytes holds one sync point: the place of its
``SEED``-byte string with the smallest hash, the leftmost of equals. Equal windows have it at the same offset, so only
suffixes at sync points are compared, each with the few bytes before it that its windows reach.

1. Blocks ask which seeds occur in a second document at all; seeds of one document cannot repeat.
2. The other suffixes of a block are sorted and front-coded: words (of eight bytes) shared with
   the one before, then the rest. Buckets by seed get one such run from each block and merge them with a loser tree, in
   which every contender carries the words it is known to share with the last winner, so known
   prefixes are never compared again. Equal suffixes leave the tree side by side and take the smallest id; unequal
   ones of one seed are compared window by window.
3. Blocks get the smallest id for every suffix, and the windows that an earlier document shares although
   the suffix as a whole is new, and remove what is covered.

A seed with very many different surroundings is sent window by window instead, to buckets by window, so that no
bucket has to hold all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm import blocks as B
from lorekeep.llm.hashing import mix64, span_hashes, window_hashes
from lorekeep.session import materialise

LENGTH, SEED = 50, 20
REACH = LENGTH - SEED  # places in a window at which its seed may begin, less one
# Different surroundings of a seed above which its windows are sent one by one.
HOT = 20_000
_PIECE = 1 << 20
# Suffixes whose keys are written at a time.
_TOGETHER = 1 << 12
# Right side, its length, left side backwards, its length, a mark for single windows; padded to whole words.
_WORDS = (LENGTH + REACH + 3 + 7) // 8
_WIDTH = 8 * _WORDS


class Points(NamedTuple):
    """Sync points of a block: windows ``first..last`` share the seed at ``at``."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    seed: np.ndarray  # hash


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sync point of every window of ``data`` and the seeds' hashes."""
    places = np.arange(len(data) - SEED + 1)
    hashes = window_hashes(data, SEED)
    n = len(data) - LENGTH + 1
    least, width = hashes, 1
    while width < REACH + 1:
        step = min(width, REACH + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    own = hashes[:n] == least
    # A window that does not begin with its minimum shares the point of the next one, unless that has a smaller one.
    changes = np.ones(n, bool)
    changes[:-1] = least[1:] != least[:-1]
    points = np.where(own, places[:n], -1)
    search = np.flatnonzero(~own & changes)
    if len(search):
        points[search] = search + hashes[search[:, None] + np.arange(REACH + 1)].argmin(axis=1)
    known = np.where(points >= 0, places[:n], n)
    return points[np.minimum.accumulate(known[::-1])[::-1]], hashes


def _documents_of(bounds: np.ndarray, start: int, end: int) -> np.ndarray:
    """The document of every byte from ``start`` up to ``end``."""
    first, last = np.searchsorted(bounds, [start, end - 1], side="right") - 1
    return np.repeat(np.arange(first, last + 1), np.diff(np.clip(bounds[first : last + 2], start, end)))


def sync_points(block: B.Block) -> Points:
    """All sync points, in order; windows never cross documents."""
    found = []
    for start in range(0, max(0, len(block.data) - LENGTH + 1), _PIECE):
        points, hashes = _piece(block.data[start : start + _PIECE + LENGTH - 1])
        where = np.arange(start, start + len(points))
        doc = _documents_of(block.bounds, start, start + len(points))
        inside = where + LENGTH <= block.bounds[doc + 1]
        where, points, doc = where[inside], points[inside], doc[inside]
        if not len(where):
            continue
        new = np.ones(len(where), bool)
        new[1:] = (points[1:] != points[:-1]) | (doc[1:] != doc[:-1]) | (where[1:] != where[:-1] + 1)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(where)) - 1
        found.append((where[begins], where[ends], points[begins] + start, doc[begins], hashes[points[begins]]))
    if not found:
        none = np.empty(0, np.int64)
        return Points(none, none, none, none, none.astype(np.uint64))
    return Points(*map(np.concatenate, zip(*found)))


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
    for start, end in zip(starts, [*starts[1:], len(keys)]):
        yield int(keys[start]), slice(start, end)


class Seeds(NamedTuple):
    """Distinct seeds of a block by bucket and mark; ``of`` tells the seed of every sync point."""

    bucket: np.ndarray
    mark: np.ndarray
    of: np.ndarray


def _seeds(points: Points, buckets: int) -> Seeds:
    bucket = (points.seed % np.uint64(buckets)).astype(np.int64)
    mark = (points.seed >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((mark, bucket))
    b, m = bucket[order], mark[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (m[1:] != m[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return Seeds(b[new], m[new], of)


def _ask_seeds(block: B.Block, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket: marks in order, whether several documents of the block hold the seed, its surroundings here."""
    points = sync_points(block)
    seeds = _seeds(points, buckets)
    n = len(seeds.mark)
    around = span_hashes(block.data, points.first, points.last + LENGTH) if n else points.seed
    # One number for a seed and its surroundings; the counts only choose between two exact ways.
    _, met = np.unique(mix64(around + seeds.of.astype(np.uint64)), return_index=True)
    kinds = np.minimum(np.bincount(seeds.of[met], minlength=n), 0xFFFF).astype(np.uint16)
    # Rows of one id are one document.
    several = np.zeros(n, np.uint8)
    ids = block.ids[points.doc] if n else points.doc
    least, most = np.full(n, B.NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, seeds.of, ids)
    np.maximum.at(most, seeds.of, ids)
    several[least != most] = 1
    for bucket, part in _slices(seeds.bucket):
        steps = np.diff(seeds.mark[part], prepend=np.uint32(0))
        yield bucket, B.squeezed(steps, several[part], kinds[part])


def _answer_seeds(asked: list[list[np.ndarray]], hot: int) -> list[bytes]:
    """For every mark: 0 if one block and document holds it, 1 if more, 2 if its surroundings are very many."""
    marks = [np.cumsum(steps, dtype=np.uint32) for steps, _, _ in asked]
    names, of = np.unique(np.concatenate(marks), return_inverse=True)
    blocks = np.bincount(of, minlength=len(names))
    several = np.bincount(of, np.concatenate([x[1] for x in asked]), len(names)) > 0
    kinds = np.bincount(of, np.concatenate([x[2] for x in asked]), len(names))
    flags = np.where((blocks > 1) | several, np.where(kinds > hot, 2, 1), 0).astype(np.uint8)[of]
    ends = np.cumsum([len(mark) for mark in marks])[:-1]
    return [B.squeezed(part) for part in np.split(flags, ends)]


class Run(NamedTuple):
    """The sorted distinct suffixes of a block, and the sync points or windows that stand behind them."""

    bucket: np.ndarray  # of each suffix
    keys: np.ndarray  # as words
    least: np.ndarray  # smallest id of each
    of: np.ndarray  # suffix of each occurrence
    first: np.ndarray  # windows of each occurrence
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray


def _run(block: B.Block, flags: dict, buckets: int) -> Run | None:
    points = sync_points(block)
    seeds = _seeds(points, buckets)
    flag = np.zeros(len(seeds.mark), np.uint8)
    for bucket, part in _slices(seeds.bucket):
        flag[part] = B.unsqueezed(flags[0, bucket])[0]
    flag = flag[seeds.of]
    warm, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
    # Windows of hot seeds stand alone.
    counts = points.last[hot] - points.first[hot] + 1
    single = np.repeat(points.first[hot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first, last = np.concatenate([points.first[warm], single]), np.concatenate([points.last[warm], single])
    at = np.concatenate([points.at[warm], single])
    doc = np.concatenate([points.doc[warm], np.repeat(points.doc[hot], counts)])
    if not len(first):
        return None
    alone = np.arange(len(first)) >= len(warm)
    seed = np.concatenate([points.seed[warm], span_hashes(block.data, single, single + LENGTH)])
    bucket = (seed % np.uint64(buckets)).astype(np.int64)
    right, left = last + LENGTH - at, at - first
    keys = np.zeros((len(first), _WIDTH), np.uint8)
    padded = np.concatenate([np.zeros(REACH, np.uint8), block.data, np.zeros(LENGTH, np.uint8)])
    behind = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    before = np.lib.stride_tricks.sliding_window_view(padded, REACH)
    # Some rows at a time, so that they stay in the processor's caches.
    for start in range(0, len(first), _TOGETHER):
        part = slice(start, start + _TOGETHER)
        keys[part, :LENGTH] = behind[at[part] + REACH] * (np.arange(LENGTH) < right[part, None])
        keys[part, LENGTH + 1 : LENGTH + 1 + REACH] = before[at[part]][:, ::-1] * (np.arange(REACH) < left[part, None])
    keys[:, LENGTH] = right
    keys[:, LENGTH + 1 + REACH] = left
    keys[:, LENGTH + 2 + REACH] = alone
    order = np.lexsort((keys.view(f"S{_WIDTH}").ravel(), bucket))
    sorted_keys, sorted_bucket = keys[order].view(">u8"), bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_bucket[1:] != sorted_bucket[:-1]) | (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), B.NO_ID)
    np.minimum.at(least, of, block.ids[doc])
    return Run(sorted_bucket[new], sorted_keys[new].astype(np.uint64), least, of, first, last, at, doc)


def _send_run(block: B.Block, flags: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket: shared words, the words that differ, smallest ids."""
    run = _run(block, flags, buckets)
    if run is None:
        return
    for bucket, part in _slices(run.bucket):
        keys = run.keys[part]
        same = np.zeros((len(keys), _WORDS), bool)
        same[1:] = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
        yield bucket, B.squeezed(same.sum(axis=1).astype(np.uint8), keys[~same], run.least[part])


class _Reader:
    """A front-coded run, suffix by suffix."""

    __slots__ = ("shared", "rest", "place", "at", "key", "n")

    def __init__(self, shared: np.ndarray, rest: np.ndarray) -> None:
        self.shared, self.rest, self.n = shared.tolist(), rest.tolist(), len(shared)
        self.place, self.at, self.key = 0, -1, [0] * _WORDS

    def next(self) -> int:
        """Moves on; gives the words shared with the suffix before, or -1 at the end."""
        self.at += 1
        if self.at == self.n:
            return -1
        shared = self.shared[self.at]
        fresh = _WORDS - shared
        self.key = self.key[:shared] + self.rest[self.place : self.place + fresh]
        self.place += fresh
        return shared


def merge(readers: list[_Reader]) -> Iterator[tuple[list[int], int, int, int]]:
    """``key, shared, run, number`` in ascending order of keys; ``shared`` words with the key given before.

    A loser tree. ``known`` holds, per run, the words its head shares with the last winner, -1 once it is
    empty. Of two heads the one that shares more is smaller; of equals, the words behind are compared, and
    the loser keeps what it was found to share with the winner.
    """
    k = 1
    while k < len(readers):
        k *= 2
    readers = readers + [_Reader(np.empty(0), np.empty(0)) for _ in range(k - len(readers))]
    known = [-1 if reader.next() < 0 else 0 for reader in readers]
    losers = [0] * k

    def play(one: int, two: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = known[one], known[two]
        if a != b:
            return (one, two) if a > b else (two, one)
        if a < 0:
            return one, two
        x, y = readers[one].key, readers[two].key
        while a < _WORDS and x[a] == y[a]:
            a += 1
        if a == _WORDS or x[a] < y[a]:
            known[two] = a
            return one, two
        known[one] = a
        return two, one

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        following = []
        for at in range(level):
            won, lost = play(winners[2 * at], winners[2 * at + 1])
            losers[level + at] = lost
            following.append(won)
        winners = following
    top = winners[0]
    while known[top] >= 0:
        reader = readers[top]
        yield reader.key, known[top], top, reader.at
        known[top] = reader.next()
        node = (k + top) // 2
        while node:
            # The way up, most often decided by what is known.
            other = losers[node]
            a, b = known[top], known[other]
            if a < b:
                losers[node], top = top, other
            elif a == b and a >= 0:
                top, losers[node] = play(top, other)
            node //= 2


def _answer_runs(sent: list[list[np.ndarray]]) -> list[bytes]:
    """For every suffix of every run: the smallest id of all blocks, and the windows an earlier document shares."""
    ids = [least.tolist() for _, _, least in sent]
    best = [np.empty(len(least), np.int64) for least in ids]
    masks = [np.zeros(len(least), np.uint32) for least in ids]
    # Suffixes of the seed at hand: key, smallest id, places (run, number).
    group: list[tuple[list[int], int, list[tuple[int, int]]]] = []

    def settle() -> None:
        if len(group) > 1 and len({least for _, least, _ in group}) > 1:
            windows: dict[tuple[int, bytes], int] = {}
            spread = []
            for key, least, _ in group:
                raw = np.array(key, ">u8").tobytes()
                right, left = raw[LENGTH], raw[LENGTH + 1 + REACH]
                before = raw[LENGTH + 1 : LENGTH + 1 + left][::-1]
                own = [(o, before[left - o :] + raw[: LENGTH - o]) for o in range(LENGTH - right, left + 1)]
                spread.append(own)
                for name in own:
                    if least < windows.get(name, least + 1):
                        windows[name] = least
            for own, (_, least, places) in zip(spread, group):
                mask = sum(1 << o for o, _ in own if windows[o, _] < least)
                for run, number in places:
                    masks[run][number] = mask
        for _, least, places in group:
            for run, number in places:
                best[run][number] = least
        group.clear()

    # Whole words that the seed fills, and the part of the next.
    whole, part = divmod(SEED, 8)
    cut = 64 - 8 * part
    for key, shared, run, number in merge([_Reader(shared, rest) for shared, rest, _ in sent]):
        least = ids[run][number]
        if group and shared == _WORDS:
            held, smallest, places = group[-1]
            places.append((run, number))
            if least < smallest:
                group[-1] = held, least, places
            continue
        # Single windows are complete; they meet no others.
        alone = key[-1] >> (8 * (_WIDTH - LENGTH - REACH - 3)) & 0xFF
        if group and (alone or shared < whole or (part and group[-1][0][whole] >> cut != key[whole] >> cut)):
            settle()
        group.append((key, least, [(run, number)]))
    settle()
    return [B.squeezed(*arrays) for arrays in zip(best, masks)]


def _covered(block: B.Block, got: dict, buckets: int) -> np.ndarray:
    """Which bytes of the block go."""
    steps = np.zeros(len(block.data) + 1, np.int64)
    run = _run(block, got, buckets)
    if run is None:
        return np.zeros(len(block.data), bool)
    best, masks = np.empty(len(run.bucket), np.int64), np.empty(len(run.bucket), np.uint32)
    for bucket, part in _slices(run.bucket):
        best[part], masks[part] = B.unsqueezed(got[1, bucket])
    least, mask = best[run.of], masks[run.of]
    late = block.ids[run.doc] > least
    np.add.at(steps, run.first[late], 1)
    np.add.at(steps, run.last[late] + LENGTH, -1)
    rest = np.flatnonzero(~late & (mask > 0))
    for o in range(REACH + 1):
        hit = rest[mask[rest] >> np.uint32(o) & np.uint32(1) > 0]
        np.add.at(steps, run.at[hit] - o, 1)
        np.add.at(steps, run.at[hit] - o + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def _finish(block: B.Block, got: dict, buckets: int, texts: bool) -> pa.Table:
    gone = _covered(block, got, buckets)
    rows: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
    for start, end in zip(block.bounds[:-1], block.bounds[1:]):
        own = gone[start:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        kept = block.data[start:end][~own].tobytes()
        rows["n_bytes"].append(len(own))
        rows["n_removed"].append(int(own.sum()))
        rows["n_spans"].append(len(edges) // 2)
        rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        rows["kept"].append(kept)
        rows["spans"].append(edges.reshape(-1, 2).tolist())
    columns = {name: pa.array(rows[name], pa.int64()) for name in ("n_bytes", "n_removed", "n_spans")}
    columns = {"doc_id": B.id_column(block.ids)} | columns | {"kept_sha256": pa.array(rows["kept_sha256"], pa.string())}
    if texts:
        columns["kept"] = pa.array(rows["kept"], pa.binary())
        columns["spans"] = pa.array(rows["spans"], pa.list_(pa.list_(pa.int64())))
    return pa.table(columns)


def suffix_dedup(
    docs: DataFrame, texts: bool = False, hot: int = HOT, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs`` (``doc_id, text``).

    With ``texts`` also ``kept`` (the bytes that stay; cut characters are possible) and ``spans`` (starts and ends of
    what goes). Null and empty texts have no bytes; a null id comes after all others; rows of the same id are
    not earlier than each other, so rows that repeat keep their text. Empty input gives no rows. Other
    columns are left behind.
    """
    blocks = B.packed(docs, block_bytes)
    n = B.bucket_count(blocks, block_bytes)
    # The first replies are used twice.
    seeds = B.asked(blocks, lambda block: _ask_seeds(block, n))
    flags = materialise(B.answered(seeds, lambda asked: _answer_seeds(asked, hot), kind=0))
    runs = B.asked_again(blocks, flags, lambda block, got: _send_run(block, got, n), kind=1)
    replies = flags.unionByName(B.answered(runs, _answer_runs, kind=1))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        schema += ", kept binary, spans array<array<long>>"
    return B.finished(blocks, replies, lambda block, got: _finish(block, got, n, texts), schema)
