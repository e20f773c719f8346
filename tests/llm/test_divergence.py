"""Divergence audit against plain loops over all terms."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cohorta.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    docs = [[x or "" for x in r] for r in rows]
    langs = defaultdict(list)
    for lang, source, text in docs:
        langs[lang].append((source, Counter(t.translate(LOWER) for t in TERM.findall(text))))
    out = set()
    for lang, items in langs.items():
        df = Counter(t for _, c in items for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        groups = defaultdict(Counter)
        for source, c in items:
            groups[source].update({t: c[t] for t in kept if t in c})
        v = len(kept)
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)

        for s, c in groups.items():
            far = [(-sum(abs(p(c, t) - p(o, t)) for t in kept), x.encode(), x) for x, o in groups.items() if x != s]
            over = [(-(p(c, t) - p(whole, t)), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            out |= {(lang, s, "pair", x, -n, k + 1) for k, (n, _, x) in enumerate(sorted(far))}
            out |= {(lang, s, "term", x, -n, k + 1) for k, (n, _, x) in enumerate(sorted(over)[:top])}
    return out


def corpus(seed, n=400, sources=7):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "été", "ÀB", "漢字", "Mixed", "MIXED"]
    out = []
    for _ in range(n):
        s = rng.randrange(sources)
        text = " ".join(rng.choice(words[s * 5:s * 5 + 60] + words[-6:]) for _ in range(rng.randrange(30)))
        out.append((rng.choice(["en", "de", None]), rng.choice([f"s{s}", f"s{s}", None]), text.replace(" w", rng.choice([" w", "1w", "\nw"]))))
    return out


def spark_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [tuple(r) for r in D.divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert spark_rows(spark, rows, least_docs=8) == brute(rows, 8)


def test_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(D, "BLOCK_CELLS", 20)
    rows = corpus(3)
    assert spark_rows(spark, rows, least_docs=5) == brute(rows, 5)


def test_hot_source_and_group_without_terms(spark):
    rows = corpus(4, 200) + [("en", "hot", "waa wba waa")] * 150 + [("en", "bare", "123 --")] * 3 + [("xx", "a", "once"), ("xx", "b", None)]
    got = spark_rows(spark, rows, least_docs=8)
    assert got == brute(rows, 8)
    assert ("xx", "a", "pair", "b", 0, 1) in got           # no kept terms: distance 0
    assert any(r[1] == "bare" and r[2] == "pair" for r in got)


def test_terms_are_the_contracts():
    texts = ["", "A1b_c É-ÀZz", "\x00a\x7fb", "x" * 50_000, "漢字 ß", "@[`{Zz}"]
    w = D.terms(pa.array(texts, pa.large_string()))
    vocab = w.vocab.to_pylist()
    for i, t in enumerate(texts):
        got = [vocab[k] for k in w.ids[w.offsets[i]:w.offsets[i + 1]]]
        assert got == [x.translate(LOWER) for x in TERM.findall(t)]


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F
    rows = [(0, 7, 3), (9_876_543_210_123, 98_765_432_101_234, 1_000_003), (5, 0, 0), (2**53 + 1, 2**53 + 9, 12)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(D.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else 0 for c, n, v in rows]


def test_odd_rows(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    got = {tuple(r) for r in D.divergence(odd, least_docs=2).collect()}
    assert got == brute(rows, 2)
    assert D.divergence(none).collect() == []
