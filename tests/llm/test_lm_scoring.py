import math
import zlib
from collections import Counter


from lorekeep.llm import lm_scoring as L
from tests.llm.conftest import odd_rows, same


def brute(rows):
    counts, found = Counter(), []
    for name, text in rows:
        words = [*(text or "").encode().lower().split(), None]
        held = zlib.crc32(b"" if name is None else str(name).encode()) % 10 == 0
        found.append((name, held, words))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    for name, held, words in found:
        base = sum(math.log10((counts[word] + 0.1) / (n + 0.1 * (v + 1))) for word in words)
        yield name, held, len(words), sum(word in counts for word in words), n, round(base, 6)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 6) as base_score")


def test_hard_cases(odd):
    rows = [row[:2] for row in odd_rows()]
    for size in (8 << 20, 500):
        scores = L.lm_scores(odd, size)
        same(scores.selectExpr(*COLUMNS).collect(), brute(rows))
        assert all(math.isfinite(row.score) and row.score < 0 for row in scores.collect())


def test_scores_do_not_depend_on_blocks(odd):
    pick = ("doc_id", "n_tokens", "round(score, 6) as score")
    same(L.lm_scores(odd).selectExpr(*pick).collect(), L.lm_scores(odd.repartition(2), 500).selectExpr(*pick).collect())


def test_no_rows(none):
    assert L.lm_scores(none).collect() == []


def test_without_training(spark):
    held = next(str(x) for x in range(100) if zlib.crc32(str(x).encode()) % 10 == 0)
    row = L.lm_scores(spark.createDataFrame([(int(held), "a b")], "doc_id long, text string")).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and math.isfinite(row.score)


def test_order_is_learned(spark):
    """Held-out texts in an order that training showed score higher than shuffled ones, and better than the base."""
    import random

    draw = random.Random(2)
    follow = {at: [draw.randrange(40) for _ in range(2)] for at in range(40)}

    def text(ordered):
        at, words = 0, []
        for _ in range(300):
            at = draw.choice(follow[at]) if ordered else draw.randrange(40)
            words.append(f"t{at}")
        return " ".join(words)

    rows = [(at, text(at < 400 or at % 2 == 0)) for at in range(500)]
    scores = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out and doc_id >= 400").collect()
    ordered = [row.score / row.n_tokens for row in scores if row.doc_id % 2 == 0]
    shuffled = [row.score / row.n_tokens for row in scores if row.doc_id % 2]
    assert min(ordered) > max(shuffled)
    assert all(row.score > row.base_score for row in scores if row.doc_id % 2 == 0)
