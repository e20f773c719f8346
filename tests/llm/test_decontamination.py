"""Greedy string tiling against the plain algorithm, both join paths, planted passages."""

import random

import numpy as np
import pytest

from cohorta.llm import decontamination as D


def plain_tiling(item, doc, k):
    """Longest common run free on both sides, marked again and again."""
    free_a, free_b = [True] * len(item), [True] * len(doc)
    tiles = covered = 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while (a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_a[a + n] and free_b[b + n]):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return tiles, covered
        for j in range(n):
            free_a[a + j] = free_b[b + j] = False
        tiles, covered = tiles + 1, covered + n


@pytest.mark.parametrize("seed", range(30))
def test_tiling_equals_plain(seed):
    rng = random.Random(seed)
    item = [rng.randrange(6 if seed % 3 else 60) for _ in range(rng.randrange(4, 40))]
    doc = [rng.randrange(60) for _ in range(20)]
    for _ in range(3):
        a = rng.randrange(len(item))
        doc[rng.randrange(len(doc)):0] = item[a:a + rng.randrange(3, 15)]
    one, two = np.array(item, np.uint64), np.array(doc, np.uint64)
    hits = [(p, q) for p in range(len(item) - 3) for q in range(len(doc) - 3) if item[p:p + 4] == doc[q:q + 4]]
    p, q = (np.array([h[i] for h in hits], np.int64) for i in (0, 1))
    assert D.tile(one, two, p, q, 4)[1] == plain_tiling(item, doc, 4)[1]


@pytest.mark.parametrize("seed", range(12))
def test_shortened_runs_tile_alike(seed):
    """Documents with long periodic runs against the plain algorithm on the whole document."""
    rng = random.Random(seed)
    unit = [rng.randrange(4) for _ in range(rng.randrange(1, 5))]
    item = (unit * 9)[:rng.randrange(4, 12)] + [rng.randrange(5) for _ in range(rng.randrange(6))]
    doc = []
    for _ in range(3):
        doc += [rng.randrange(6) for _ in range(rng.randrange(9))] + unit * rng.randrange(20, 45) + item[rng.randrange(3):]
    one, two = np.array(item, np.uint64), np.array(doc, np.uint64)
    short, off = D.shorten(two, np.array([0, len(two)]), len(item))
    assert len(short) <= len(two) and off[-1] == len(short)

    def covered(doc):
        hits = [(p, q) for p in range(len(item) - 3) for q in range(len(doc) - 3) if item[p:p + 4] == doc[q:q + 4]]
        p, q = (np.array([h[i] for h in hits], np.int64) for i in (0, 1))
        return D.tile(one, np.array(doc, np.uint64), p, q, 4)[1]

    assert covered(short.tolist()) == covered(doc) == plain_tiling(item, doc, 4)[1]


def test_runs_end_with_their_document():
    code, off = D.shorten(np.ones(60, np.uint64), np.array([0, 20, 20, 40, 60]), 10)
    assert len(code) == 60 and off.tolist() == [0, 20, 20, 40, 60]
    code, off = D.shorten(np.concatenate([np.ones(500, np.uint64), np.arange(30, dtype=np.uint64)]), np.array([0, 500, 530]), 10)
    assert off.tolist() == [0, 40, 70] and code[-30:].tolist() == list(range(30))


def test_a_million_equal_words():
    import tracemalloc
    import pyarrow as pa
    items = D.Items(pa.array([1, 2], pa.int64()), pa.array(["same " * 200, "one two three four " * 40], pa.large_string()), 4)
    texts = pa.array(["same " * 1_000_000, "x " + "one two three four " * 100_000 + "y"], pa.large_string())
    tracemalloc.start()
    got = list(items.matches(texts, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, 1, 200), (1, 1, 1, 160)] and peak < 500e6


def test_karp_rabin_rolls():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 5, 400).astype(np.uint64)
    h = D.karp_rabin(code, 4)
    for i in range(0, 390, 13):
        for j in range(0, 390, 17):
            assert (h[i] == h[j]) == (code[i:i + 4] == code[j:j + 4]).all()
    assert len(D.karp_rabin(code[:3], 4)) == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [" ".join(f"b{rng.randrange(3000)}" for _ in range(30)) for _ in range(12)] + [None, "", "too short", "Same, same same SAME same same"]

    def prose(n):
        return " ".join(f"d{rng.randrange(9000)}" for _ in range(n))

    w = items[0].split()
    docs = [prose(80) + " " + items[0] + " " + prose(50), " ".join(w[15:]) + " " + prose(20) + " " + " ".join(w[:15]).upper() + "!",
            prose(30) + " " + " ".join(items[1].split()[:18]), prose(30) + " " + " ".join(items[1].split()[:9]), prose(200), None, "",
            items[2] + "\n" + items[3], "same same same same", prose(20_000) + " " + items[4], prose(50) + " " + items[0]]
    return (spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
            spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))


def test_planted_passages_on_both_paths(planted):
    docs, items = planted
    local = sorted(map(tuple, D.contaminated(docs, items).collect()))
    joined = sorted(map(tuple, D.contaminated(docs, items, local_tokens=0).collect()))
    assert local == joined
    assert {(r[0], r[1]) for r in local} == {(0, 0), (1, 0), (2, 1), (7, 2), (7, 3), (8, 15), (9, 4), (10, 0)}
    assert next(r for r in local if r[:2] == (1, 0))[2:4] == (2, 30)            # reordered: two tiles, all covered


def test_keep_clean(planted, odd, none, spark):
    docs, items = planted
    for limit in (10**6, 0):
        assert sorted(r.doc_id for r in D.keep_clean(docs, items, local_tokens=limit).collect()) == [3, 4, 5, 6]
    kept = D.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert D.keep_clean(none, items).count() == 0 and D.contaminated(none, items).count() == 0
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, no_items).count() == 0 and D.keep_clean(docs, no_items).count() == docs.count()


def test_driver_passages(docs, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    text = {r.item_id: r.text for r in items.collect()}
    whole = {(d.doc_id, i) for d in docs.collect() for i, t in text.items() if t and t in (d.text or "")}
    assert whole and whole <= got
