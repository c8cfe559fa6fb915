import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from lorekeep.llm import near_dedup as N
from tests.llm.conftest import odd_rows, same


def brute(rows, similar=0.8):
    """Groups by comparing all pairs; rows by place."""
    bags = [N.bag(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        if (rows[x][1] or "") == (rows[y][1] or "") or N.similarity(bags[x], bags[y]) >= similar:
            root[top(x)] = top(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[top(x)].append(rows[x][0])
    order = lambda name: (name is None, name or 0)
    for x, (name, _) in enumerate(rows):
        members = groups[top(x)]
        first = min(members, key=order)
        yield name, first, len(members), name == first


def test_hard_cases(odd):
    same(N.near_duplicates(odd).collect(), brute([row[:2] for row in odd_rows()]))


def test_no_rows(none):
    assert N.near_duplicates(none).collect() == [] and N.keep_one(none).collect() == []


def test_against_brute_force(spark):
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randint(0, 3000)}" for _ in range(n)]
    rows = []
    for _ in range(25):
        text = words(draw.randint(60, 300))
        for _ in range(draw.randint(1, 6)):
            copy = list(text)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy)))
            if draw.random() < 0.5:
                text = copy
    # Texts that share a long passage and little else land in common buckets.
    passage = words(80)
    rows += [(len(rows) + at, " ".join(passage + words(60))) for at in range(25)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(N.near_duplicates(docs).collect(), brute(rows))


def test_links_besides_a_failed_one_are_tried(spark, monkeypatch):
    draw = random.Random(8)
    rows = []
    for family in range(60):
        text = [f"w{draw.randint(0, 9999)}" for _ in range(200)]
        # The last is at 0.793 from the first, which may lead the bucket, and at 0.804 from the second; or two classes of
        # several texts are near each other, near enough one pair alone.
        for cut in (0, 1, 18) if family % 2 else (0, 2, 3, 20, 22, 23):
            rows.append((len(rows), " ".join(text[cut : cut + 160])))
    want = list(brute(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(N.near_duplicates(docs).collect(), want)
    # The same with buckets of several blocks.
    monkeypatch.setattr(N, "BLOCK", 2)
    same(N.near_duplicates(docs).collect(), want)


def labelled_links(bags, labels, sides=None, similar=0.8):
    """Components of labels by all pairs, and by the join."""

    def merged(pairs):
        root = {label: label for label in labels}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[top(labels[x])] = top(labels[y])
        return [top(label) for label in labels]

    everything = [
        (x, y) for x, y in combinations(range(len(bags)), 2)
        if labels[x] != labels[y] and (sides is None or sides[x] != sides[y]) and N.similarity(bags[x], bags[y]) >= similar - 1e-9
    ]
    found = N.links_between(labels, bags, sides, similar)
    assert all((x, y) in everything for x, y in found)
    partition = lambda tops: {frozenset(at for at, one in enumerate(tops) if one == other) for other in set(tops)}
    assert partition(merged(found)) == partition(merged(everything))
    return found


def test_join_of_a_bucket_against_all_pairs():
    draw = np.random.default_rng(5)
    for trial in range(40):
        names = np.unique(draw.integers(0, 400, 90)).astype(np.uint64)
        bags, labels = [], []
        for row in range(30):
            kept = draw.random(len(names)) < draw.choice([0.8, 0.9, 0.97])
            extra = np.unique(draw.integers(500, 600, draw.integers(0, 12))).astype(np.uint64)
            own = np.concatenate([names[kept], extra])
            bags.append((own, draw.integers(1, 4, len(own)) if trial % 2 else np.ones(len(own), np.int64)))
            labels.append(b"%d" % (row if trial % 3 else row // 3))
        labelled_links(bags, labels, draw.integers(0, 2, 30) if trial % 4 == 3 else None)


def test_a_template_costs_no_pairs(monkeypatch):
    # 3,000 pages that have seven tenths in common, and one pair that is near.
    draw = np.random.default_rng(6)
    template = np.arange(210, dtype=np.uint64)
    pages = [np.concatenate([template, np.sort(draw.choice(1 << 40, 90, replace=False)).astype(np.uint64) + np.uint64(1000)]) for _ in range(2999)]
    near = pages[1234].copy()
    near[-5:] += np.arange(1, 6, dtype=np.uint64)
    bags = [(names, np.ones(len(names), np.int64)) for names in [*pages, np.sort(near)]]
    compared = []
    similarity = N.similarity
    monkeypatch.setattr(N, "similarity", lambda a, b: compared.append(1) or similarity(a, b))
    assert N.links_between([b"%d" % at for at in range(3000)], bags, None, 0.8) == [(1234, 2999)]
    assert len(compared) < 10


def test_one_row_of_each_class_stays(odd):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    groups = {row.group_id for row in N.near_duplicates(odd).collect()}
    assert len(groups) <= kept.count() <= len(groups) + 2
    assert kept.count() == kept.dropDuplicates(["text"]).count()


def test_registers_estimate_the_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        keys = np.unique(draw.integers(0, 1 << 62, 300).astype(np.uint64))
        weights = draw.integers(1, 4, len(keys))
        other = draw.random(len(keys)) < 0.9
        a, b = (keys, weights), (keys[other], weights[other])
        assert abs(N.similarity(a, b) - N.similarity(b, a)) < 1e-9
        errors.append(np.mean(N.signature(*a) == N.signature(*b)) - N.similarity(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_similarity_does_not_depend_on_scale():
    keys = np.arange(10, dtype=np.uint64)
    counts = np.arange(1, 11)
    assert abs(N.similarity((keys, counts), (keys, 3 * counts)) - 1) < 1e-12
    assert N.similarity((keys, counts), (keys + np.uint64(20), counts)) == 0
