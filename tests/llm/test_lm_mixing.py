"""Every bit of a word goes through the mixer, state lasts to the end of a text, and unseen words are spelled by what training showed."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from lorekeep.llm import lm_scoring as L, spelling as S
from lorekeep.llm.hashing import mix64

HELD = [n for n in range(4000) if zlib.crc32(str(n).encode()) % 10 == 0]
TRAINED = [n for n in range(4000) if zlib.crc32(str(n).encode()) % 10]


def scored(spark, rows):
    return {row.doc_id: row for row in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def vocabulary(n):
    """Tokens with counts, places and corpus as one bucket gives them."""
    draw = np.random.default_rng(3)
    names = np.unique(mix64(np.arange(n, dtype=np.uint64)))
    counts = np.floor(1 + draw.pareto(1.0, n)).astype(np.float64)
    asked = [np.diff(names, prepend=np.uint64(0)), counts.astype(np.uint32), *[np.zeros(n * L.CLASSES, np.uint32)] * 2]
    _, _, _, sums, ranks = L.B.unsqueezed(L._answer([asked])[0])
    mass, size, once = sums.reshape(3, L.CELLS).astype(float)
    by_class = lambda x: x.reshape(L.CLASSES, L.BANDS).sum(axis=1)
    corpus = L.Corpus(by_class(mass), by_class(size), by_class(once), mass, size.astype(np.int64), np.zeros((1, L.CELLS), np.int64))
    return names, counts, ranks.astype(np.int64), corpus


def test_chances_of_a_closed_vocabulary_make_one():
    names, counts, ranks, corpus = vocabulary(700)
    inner = L.paths(names, counts, ranks, corpus)
    logs = np.log(np.where(inner.bit > 0, inner.prior, 1 - inner.prior))
    told = np.exp(np.bincount(np.repeat(np.arange(len(names)), inner.length), logs, len(names)))
    assert np.bincount(L._class(names), told, L.CLASSES) == pytest.approx(np.ones(L.CLASSES))

    # And behind the same words, all that a known word can be makes one: class bits, band and place, mixed.
    before = [0, 5, 9, 5, 0, 5]
    total = 0.0
    for last in range(len(names)):
        of = np.array([*before, last])
        n = len(of)
        seen = L.Tokens(names, np.zeros(len(names), np.int64), of, np.zeros(n, np.int64), np.append(0, of[:-1]), np.append([0, 0], of[:-2]))
        flat = np.zeros((len(names), L.CLASSES), np.float32)
        logs = L.mixed(seen, L._class(names)[of], np.ones(n, bool), np.zeros(n, bool), flat, flat, corpus, inner)
        total += np.exp(logs[-1])
    # What is missing is the chance of a word that training never showed.
    assert 0.9 < total < 1


def test_memory_of_a_block_of_many_documents():
    """What documents learn is held for those side by side, not for all of a block; so are decisions while they are looked for."""
    names, counts, ranks, corpus = vocabulary(100_000)
    tracemalloc.start()
    inner = L.paths(names, counts, ranks, corpus)
    kept, peak = tracemalloc.get_traced_memory()
    assert peak < 2.5 * kept
    docs = 10_000
    of = np.random.default_rng(5).integers(0, len(names), 3 * docs)
    seen = L.Tokens(names, np.zeros(len(names), np.int64), of, np.arange(3 * docs) // 3, np.roll(of, 1), np.roll(of, 2))
    flat = np.zeros((len(names), L.CLASSES), np.float32)
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    L.mixed(seen, L._class(names)[of], np.ones(len(of), bool), np.zeros(len(of), bool), flat, flat, corpus, inner)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 100 << 20


def test_a_long_text_remembers_its_beginning(spark):
    """Words that stood 1,500 tokens before are told with fewer bits than words that did not."""
    draw = random.Random(1)
    words = [f"w{at}" for at in range(6000)]
    rows = [(n, " ".join(draw.choices(words, k=300))) for n in TRAINED[:200]]
    passage, other = draw.sample(words, 1500), draw.sample(words, 1500)
    rows += [(HELD[0], " ".join(passage + passage)), (HELD[1], " ".join(passage + other))]
    scores = scored(spark, rows)
    again, fresh = scores[HELD[0]], scores[HELD[1]]
    # The texts share their first half; of the second, a repeated word costs one digit less at least.
    assert again.score - fresh.score > 1500


def test_unseen_words_of_known_syllables():
    """Words put together from syllables are told with far fewer bits by what stands behind two and three bytes; others still are told."""
    draw = random.Random(7)
    syllables = ["tion", "ing", "the", "ness", "and", "ment", "able", "ous", "pre", "con", "est", "ly"]
    word = lambda: "".join(draw.choices(syllables, k=4)).encode()
    text = b" ".join(word() for _ in range(5000))
    docs = [[word() for _ in range(40)] for _ in range(20)] + [[b"\xff0000x", b""]]
    pairs = S.letter_pairs(text)
    short, deep = (S.spelled(docs, known) for known in (S.letters(pairs), S.letters(pairs, S.letter_contexts(text))))
    assert all(np.isfinite(logs).all() and (logs < 0).all() for logs in deep)
    assert sum(logs.sum() for logs in deep[:-1]) > 0.75 * sum(logs.sum() for logs in short[:-1])


def told(of, names, counts, ranks, corpus):
    n = len(of)
    seen = L.Tokens(names, np.zeros(len(names), np.int64), of, np.zeros(n, np.int64), np.append(0, of[:-1]), np.append([0, 0], of[:-2]))
    flat = np.zeros((len(names), L.CLASSES), np.float32)
    inner = L.paths(names, counts, ranks, corpus)
    return L.mixed(seen, L._class(names)[of], counts[of] > 0, np.zeros(n, bool), flat, flat, corpus, inner)


def test_a_long_text_takes_few_steps(monkeypatch):
    """A text of 20,000 tokens is told in some hundred steps, each from what stood before it alone, and what it repeats costs less."""
    known = vocabulary(3000)
    of = np.random.default_rng(2).integers(0, 3000, 10_000)
    calls, bend = [], L._bend
    monkeypatch.setattr(L, "_bend", lambda dot: calls.append(1) or bend(dot))
    logs = told(np.concatenate([of, of]), *known)
    assert len(calls) < 5000
    assert np.isfinite(logs).all() and logs[10_000:].sum() > 0.8 * logs[:10_000].sum()
    other = told(np.concatenate([of, of[:5000], of[:5000][::-1]]), *known)
    assert (other[:15_000] == logs[:15_000]).all()


def test_tokens_stand_by_step():
    length = np.array([200_000, 2 * L._STEPS + 1, L._STEPS, 3, 1])
    start = np.cumsum(length) - length
    places, lane, before, begin = L._steps(start, length)
    assert (np.sort(places) == np.arange(length.sum())).all()
    assert (places >= start[lane] + before).all()
    sizes = np.array([np.bincount(lane[a:b], minlength=5) for a, b in zip(begin[:-1], begin[1:])])
    assert sizes.max(axis=0).tolist() == [L._MOST_A_STEP, 3, 1, 1, 1]
    # What is told in a step stands behind all that was told before it.
    for at, n in enumerate(length):
        mine = places[lane == at]
        assert (mine == start[at] + np.arange(n)).all()


@pytest.mark.parametrize("distinct", [1, 2, 3000])
def test_very_long_texts_stay_finite(distinct):
    """Where a hundred tokens are told in a step, maps stay chances, whatever the tokens are."""
    of = np.random.default_rng(3).integers(0, distinct, 60_000)
    logs = told(of, *vocabulary(3000))
    assert np.isfinite(logs).all() and (logs <= 0).all()


@pytest.mark.parametrize("counted", [50, 10])
def test_visits_against_plain_python(monkeypatch, counted):
    """How often a document came to each decision before, and took its set bit, alone and behind the token before."""
    monkeypatch.setattr(L, "_COUNTED", counted)
    names, counts, ranks, corpus = vocabulary(60)
    inner = L.paths(names, counts, ranks, corpus)
    draw, length = np.random.default_rng(4), np.array([90, 40, 40, 1, 7])
    token = np.minimum(draw.geometric(0.1, length.sum()), 60) - 1
    known, classes, before = draw.random(len(token)) < 0.9, L._class(names)[token], np.roll(token, 1)
    words = L._Words(inner, length, token, known, classes, before)
    seen, bits = {}, inner.bit
    for at, doc in enumerate(np.repeat(np.arange(len(length)), length)):
        path = bits[inner.start[token[at]] :][: inner.length[token[at]] * known[at]].tolist()
        been = 0
        for level, bit in enumerate(path):
            for mark, behind in zip(words.marks, (None, before[at])):
                past = seen.setdefault((doc, behind, classes[at], *path[:level]), [])
                assert divmod(int(mark[words.begin[at] + level]), 1 << 16) == (len(past), sum(past))
                been += behind is None and len(past) > 0
                past.append(bit)
        assert words.been[at] == been


def test_counts_stay_within_their_bits():
    """Of what came very often the share is kept."""
    n = 150_000
    out = np.zeros(2 * n, np.uint32)
    code = np.where(np.arange(n) % 3 == 0, np.uint64(0b11) << np.uint64(62), np.uint64(0b01) << np.uint64(62))
    L._visits(np.zeros(n, np.int64), code, 2 * np.arange(n), out)
    assert int(out[-2]) >> 16 == L._MOST and int(out[-2]) & 0xFFFF == pytest.approx(L._MOST / 3, rel=1e-3)


def test_documents_of_a_block_share_their_steps(monkeypatch):
    """Six hundred texts of a thousand tokens, as a block holds, take no more steps than one."""
    known = vocabulary(50)
    names, counts, ranks, corpus = known
    of = np.random.default_rng(8).integers(0, 50, 600_000)
    doc = np.arange(len(of)) // 1000
    flat, steps, step = np.zeros((50, L.CLASSES), np.float32), [], L._Classes.step
    monkeypatch.setattr(L._Classes, "step", lambda *args: steps.append(1) or step(*args))
    seen = L.Tokens(names, np.zeros(50, np.int64), of, doc, np.where(np.arange(len(of)) % 1000, np.roll(of, 1), 0), np.roll(of, 2))
    logs = L.mixed(seen, L._class(names)[of], counts[of] > 0, np.zeros(len(of), bool), flat, flat, corpus, L.paths(names, counts, ranks, corpus))
    assert len(steps) <= L._STEPS and np.isfinite(logs).all()


def test_a_chance_next_to_one_stays_a_chance():
    """Where nearly all of a class has one band, single precision takes its share for one; the others are told all the same."""
    names, counts, ranks, corpus = vocabulary(700)
    mass = corpus.mass.copy()
    mass[mass.argmax()] = 1e12
    inner = L.paths(names, counts, ranks, corpus._replace(mass=mass))
    assert (inner.prior > 0).all() and (inner.prior < 1).all()
