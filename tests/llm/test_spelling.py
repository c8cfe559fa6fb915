"""Spellings of unseen words against a mixer in plain Python, and as probabilities."""

import math
import random

import numpy as np
import pytest

from lorekeep.llm import lm_scoring as L
from lorekeep.llm import spelling as S

TRAINED = b"the quick brown fox jumps over the lazy dog and then the other one "


def logit(p):
    return math.log(p / (1 - p))


def brute(words, pairs):
    """Logs of one document's words: a dict per order, decision after decision, learned from word by word."""
    after, alone = {}, {}

    def chances(table, context, count):
        for level in range(8):
            for byte, n in count.items():
                key = (context, level, byte >> (8 - level))
                ones, total = table.get(key, (0, 0))
                table[key] = (ones + n * (byte >> (7 - level) & 1), total + n)

    whole = {byte: int(pairs[byte::256].sum()) for byte in range(256)}
    chances(alone, None, whole)
    for before in range(256):
        chances(after, before, {byte: int(pairs[before * 256 + byte]) for byte in range(256)})
    own, weights, out = {}, [list(S._START) for _ in range(S._GATES)], []
    for word in words:
        told, lessons = 0.0, []
        text = word + b" "
        for place, byte in enumerate(text):
            before = text[place - 1] if place > 0 else 0x20
            earlier = text[place - 2] if place > 1 else 0x20
            for level in range(8):
                prefix, bit = byte >> (8 - level), byte >> (7 - level) & 1
                ones, total = alone[None, level, prefix]
                everywhere = (ones + 0.4) / (total + 0.8)
                ones, total = after[before, level, prefix]
                behind = (ones + 2 * everywhere) / (total + 2)
                node = (1 << level) | prefix
                slots = S._slots(np.array([before]), np.array([earlier]), np.array([[node]]))[0, 0].tolist()
                keys = list(enumerate(slots))
                x = [logit(everywhere), logit(behind)]
                for key in keys:
                    zeros, ones = own.get(key, (0, 0))
                    x.append(logit((ones + S._PRIOR * behind) / (zeros + ones + S._PRIOR)))
                gate = min(place, S._GATES - 1)
                dot = max(-S._REACH, min(S._REACH, sum(a * b for a, b in zip(weights[gate], x))))
                p = 1 / (1 + math.exp(-dot))
                told += math.log(p if bit else 1 - p)
                lessons.append((gate, [S._RATE * (bit - p) * a for a in x], keys, bit))
        for gate, steps, keys, bit in lessons:
            weights[gate] = [a + b for a, b in zip(weights[gate], steps)]
            for key in keys:
                zeros, ones = own.get(key, (0, 0))
                own[key] = (zeros + 1 - bit, ones + bit)
        out.append(told)
    return out


def test_equal_to_plain_python():
    pairs = S.letter_pairs(TRAINED)
    draw = random.Random(3)
    docs = [[bytes(draw.choice(b"abcxyz\xc3\xa9") for _ in range(draw.randint(0, 12))) for _ in range(n)] for n in (0, 1, 7, 30)]
    got = S.spelled(docs, S.letters(pairs))
    for words, logs in zip(docs, got):
        assert logs.tolist() == pytest.approx(brute(words, pairs), rel=1e-9)
    assert S.spelled([], S.letters(pairs)) == []


def test_words_share_one():
    """Where every trained word is a letter, the empty word and the words of one byte hold nearly all the probability."""
    short = [b"", *(bytes([byte]) for byte in range(256) if byte != 0x20)]
    total = lambda trained, before: sum(
        math.exp(logs[-1]) for logs in S.spelled([[*before, word] for word in short], S.letters(S.letter_pairs(trained)))
    )
    for before in ([], [b"d", b"c"]):
        assert 0.99 < total(b"a b c d " * 20_000, before) <= 1
        assert 0 < total(TRAINED, before) < 1
        assert 0 < total(b"", before) < 1


def test_long_words_and_repeats():
    known = S.letters(S.letter_pairs(TRAINED))
    noise = random.Random(4).randbytes(20_000).translate(S._BLANK).replace(b" ", b"x")
    once = S.spelled([[noise]], known)[0]
    assert np.isfinite(once).all() and once[0] < -20_000
    # A word that comes again is told with fewer bits; documents do not learn from each other.
    logs = S.spelled([[b"qwertz"] * 30, [b"qwertz"]], known)
    assert logs[0][-1] > logs[0][0] / 4 and logs[0][0] == pytest.approx(logs[1][0])


def test_unseen_words_are_paid_for(spark):
    """A text of words that training never showed scores below a clean one, per byte and in all."""
    import zlib

    draw = random.Random(9)
    held = [n for n in range(4000) if zlib.crc32(str(n).encode()) % 10 == 0]
    trained = [n for n in range(4000) if n not in set(held)][:200]
    vocabulary = ["".join(draw.choice("aeioubdlmnrst") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    junk = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(7)) for _ in range(1000))
    rows = [(n, prose(300)) for n in trained] + [(held[0], prose(1000)), (held[1], junk)]
    scores = {row.doc_id: row for row in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clean, noise = scores[held[0]], scores[held[1]]
    assert noise.n_known == 1 and clean.n_known == clean.n_tokens
    assert noise.bits_per_byte > 3 > clean.bits_per_byte and noise.score < noise.base_score / 2 < clean.score / 2


def test_many_unseen_words_take_few_steps(monkeypatch):
    """Four thousand unseen words of one text are told in some hundred steps, each from the words before alone."""
    draw = random.Random(6)
    words = [bytes(draw.choices(range(97, 123), k=8)) for _ in range(4000)]
    known = S.letters(S.letter_pairs(b" ".join(words[:50])))
    calls, slots = [], S._slots
    monkeypatch.setattr(S, "_slots", lambda *args: calls.append(1) or slots(*args))
    (logs,) = S.spelled([words], known)
    assert len(calls) <= S._STEPS and np.isfinite(logs).all()
    (other,) = S.spelled([words[:2000] + words[:2000]], known)
    assert other[:2000] == pytest.approx(logs[:2000]) and other[2000:].sum() > logs[2000:].sum()
