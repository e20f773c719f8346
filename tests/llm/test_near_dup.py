"""BagMinHash near duplicates against all pairs of exact multiset overlaps."""

import collections
import random

import numpy as np
import pytest

from cohorta.llm import near_dup as N


def bags(text):
    w = (text or "").split()
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return collections.Counter(grams)


def overlap(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(texts):
    """Class of each row: components of all pairs at 0.8 or more."""
    bag = [bags(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bag[i] and bag[j] and overlap(bag[i], bag[j]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def family(rng, n, edits):
    words = [f"w{rng.randrange(4000)}" for _ in range(n)]
    while True:
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(n)] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = []
    for n, edits, size in ((150, 2, 30), (150, 4, 25), (60, 1, 12), (30, 1, 6), (9, 0, 4), (3, 0, 3)):
        f = family(rng, n, edits)
        out += [next(f) for _ in range(size)]
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(120))
    out += [" ".join(f"q{rng.randrange(10**9)}" for _ in range(k)) + " " + passage for k in range(2, 60, 2)]
    out += ["one two three four five six " * 20, "one two three four five six " * 21, "", None, " ", "a", "a", "a b"]
    return out


def test_classes_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_exact_pairs_skip_the_signature_test(spark, texts, monkeypatch):
    real, kept = N._linked, []

    def linked(rows, nodes, pairs, threshold):
        # the first step as it is; in the second no two signatures agree enough
        monkeypatch.setattr(N, "LEAST_AGREEING", N.COMPONENTS + 1 if kept else least)
        kept.append(real(rows, nodes, pairs, threshold))
        return kept[-1]

    least = N.LEAST_AGREEING
    monkeypatch.setattr(N, "_linked", linked)
    monkeypatch.setattr(N, "_spanning", lambda rest: rest.withColumn("root", N.F.col("node")))   # all go on
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    N.links(N.signed(df).cache(), 0.8).collect()
    assert len(kept) == 2 and kept[1].count() > 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    z = []
    for _ in range(60):
        a = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, 2**62, rng.integers(5, 40))}
        b = {k: max(1, v + int(rng.integers(-3, 4))) for k, v in a.items() if rng.random() < .8}
        b |= {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, 2**62, rng.integers(1, 9))}
        both = sum(min(a[k], b[k]) for k in a if k in b)
        j = both / (sum(a.values()) + sum(b.values()) - both)
        doc = np.repeat([0, 1], [len(a), len(b)])
        sig = N.signatures(doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, m=800)
        z.append(((sig[0] == sig[1]).mean() - j) / max(1e-9, np.sqrt(j * (1 - j) / 800)))
    assert abs(np.mean(z)) < 0.5 and np.std(z) < 1.4


def test_prefix_join_finds_all_pairs(spark, texts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = N.signed(df).filter("n > 0").cache()
    wanted = rows.select("node").distinct().withColumn("root", F.col("node"))
    found = {tuple(sorted((r.a, r.b))) for r in N._prefix_pairs(rows, wanted, 0.8).distinct().collect()}
    node = {r.doc_id: r.node for r in rows.select("doc_id", "node").collect()}
    bag = {i: bags(t) for i, t in enumerate(texts) if t and t.split()}
    for i in bag:
        for j in bag:
            if j < i and node[i] != node[j] and overlap(bag[i], bag[j]) >= 0.8:
                assert tuple(sorted((node[i], node[j]))) in found


def test_keep_one_keeps_a_row_of_each_class(spark, odd, none):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id or -1), r.text or "") for r in kept.collect())
    prose = next(r.text for r in odd.collect() if r.doc_id == 1)
    assert [i for i, t in got if t == prose] == [1]                  # five copies, one stays
    assert sum(1 for _, t in got if not t.strip()) == 4              # texts without words are no copies
    assert N.keep_one(none).count() == 0 and N.classes(none).count() == 0


def test_odd_rows(odd):
    rows = N.classes(odd).collect()
    assert len(rows) == odd.count()
    size = collections.Counter(r.class_id for r in rows if r.n_shingles)
    assert size[1] == 4 and all(r.class_size == 4 for r in rows if r.class_id == 1 and r.n_shingles)
