"""Quality rules and classifier: counts against plain Python, MCD against numpy, held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohorta.llm import quality_classifier as C
from cohorta.llm import quality_rules as Q
from cohorta.llm.textstats import counts
from tests.llm.conftest import SF


def plain(text):
    """The five base counts, by definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered))


def test_base_counts(docs, odd):
    texts = [r.text or "" for r in docs.select("text").limit(120).collect()] + [r.text or "" for r in odd.select("text").collect()]
    texts += ["a a a a a a a", "a b c d e f a b c d e", "x\nx\n \n \nx", "#*$%&|<> <é|漢>", " b", "\n\n"]
    c = counts(pa.array(texts, pa.large_string()))
    got = list(zip(*[c[k].tolist() for k in Q.BASE]))
    assert got == [plain(t) for t in texts]


def test_chi_square():
    assert Q.chi2_cdf(7.344, 8) == pytest.approx(0.5, abs=1e-4)
    assert Q.chi2_tail(15.507, 8) == pytest.approx(0.05, abs=1e-4)


def plain_mcd(x, noise, steps):
    """The same concentration steps on one group in numpy, without buckets."""
    q = np.round(np.quantile(x, [.25, .5, .75], axis=0, method="inverted_cdf") * 256) / 256
    best = None
    for spread in (np.diag(((q[2] - q[0]) / 1.349) ** 2), np.zeros((Q.P, Q.P))):
        mean, cov = q[1], spread
        for _ in range(steps):
            d = Q.distance2(x, noise, np.tile(mean, (len(x), 1)), np.tile(cov, (len(x), 1, 1)))
            near = x[np.argsort(d, kind="stable")[:int(np.ceil(Q.SUPPORT * len(x)))]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * Q.CONSISTENCY
        det = np.linalg.slogdet(cov + np.diag(Q.FLOOR2))[1]
        best = (det, mean, cov) if best is None or det < best[0] - 1e-9 else best
    return best[1], best[2]


def test_estimate_and_verdicts_against_numpy(spark, docs):
    measured = Q.measure(docs.repartition(4)).cache()
    rows = [r.asDict() for r in measured.collect()]
    c = {k: np.array([r[k] for r in rows]) for k in Q.FIELDS}
    x, noise = Q.vector(c)
    ok = ~Q.base_failed(c)
    got = {r["doc_id"]: r for r in (y.asDict() for y in Q.judge(measured, Q.estimates(measured)).collect())}
    langs = np.array([r["lang"] for r in rows], object)
    assert len(got) == len(rows)
    agree = []
    for i, r in enumerate(rows):
        group = ok & (langs == r["lang"])
        if group.sum() < Q.MIN_ROWS:
            group = ok                                   # every language and source here is small
        if "_fit" not in r:
            key = group.tobytes()
            plain_mcd.cache = getattr(plain_mcd, "cache", {})
            if key not in plain_mcd.cache:
                plain_mcd.cache[key] = plain_mcd(x[group], noise[group], Q.STEPS)
        mean, cov = plain_mcd.cache[key]
        d = Q.distance2(x[i:i + 1], noise[i:i + 1], mean[None], cov[None])[0]
        g = got[r["doc_id"]]
        assert g["base_failed"] == (not ok[i])
        # buckets take the support share a little wider, so distances differ a little
        agree.append(g["kept"] == (ok[i] and d <= Q.CUT))
        if 1 < d < 400:
            assert g["distance"] == pytest.approx(d, rel=0.5)
    assert np.mean(agree) > 0.985


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_rules(docs).join(labels, "doc_id").filter("not base_failed").select("quality", "kept").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.2


def test_quality_rules_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_words): r for r in Q.quality_rules(odd).collect()}
    assert rows[2, 0].base_failed and not rows[3, 0].kept and rows[5, 60_000].n_words == 60_000
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 6]
    assert Q.quality_rules(none).count() == 0 and Q.keep_good(none).count() == 0


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    n1 = label.sum()
    return (rank[label].sum() - n1 * (n1 + 1) / 2) / (n1 * (~label).sum())


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = C.quality_scores(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    label = np.array([r.quality == 1 for r in held])
    assert auc(np.array([r.score for r in held]), label) > 0.97
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in held]) > 0.95


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    good = x @ [2.0, -1, 0, 0] + rng.logistic(size=600) > 0
    m = C.fit(x, good, int(good.sum()), int((~good).sum()))
    s = m.score(x)
    assert auc(s, good) > 0.85 and m.weight[0] > 0 > m.weight[1]
    # the cut leaves out the share labelled 0
    assert np.mean(s < C.CUT_SCORE) == pytest.approx(np.mean(~good), abs=0.02)


def pairs_fit(x, good, times, rounds=60):
    """Bradley-Terry weights by plain Newton steps over every single pair."""
    mean = np.average(x, axis=0, weights=times)
    z = (x - mean) / np.sqrt(np.average((x - mean) ** 2, axis=0, weights=times))
    d = (z[good][:, None] - z[~good][None]).reshape(-1, x.shape[1])
    w = (times[good][:, None] * times[~good][None]).ravel().astype(float)
    w, b = w / w.sum(), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(d @ b)))
        hess = (d * (w * p * (1 - p))[:, None]).T @ d + C.RIDGE * np.eye(len(b))
        b += np.linalg.solve(hess, d.T @ (w * (1 - p)) - C.RIDGE * b)
    return b


def test_fit_covers_every_pair():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=500), rng.exponential(size=500), rng.normal(size=500) * 9 + 40])
    good = x @ [3.0, -2, 0.02] + rng.logistic(size=500) > 0
    times = rng.integers(1, 9, size=500)
    n1, n0 = int(times[good].sum()), int(times[~good].sum())
    m = C.fit(x, good, n1, n0, times)
    assert np.allclose(m.weight, pairs_fit(x, good, times), rtol=1e-6, atol=1e-7)
    s = ((x - m.mean) / m.scale) @ m.weight
    order = np.argsort(s)
    below = np.cumsum(times[order]) / times.sum()
    assert m.cut == pytest.approx(s[order[np.searchsorted(below, n0 / (n1 + n0) - 1e-12)]], abs=1e-9)


def test_query_learns_from_every_labelled_text(spark, monkeypatch):
    """Not from a sample of some thousands a class; ids and texts may repeat, and so may labels."""
    rng = np.random.default_rng(3)
    n = 18_000
    clean = rng.random(n) < 0.6
    texts = [" ".join(("word" if c else "#x9") + ("" if rng.random() < 0.5 else ".") for _ in range(3 + i % 4)) for i, c in enumerate(clean)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    label = {i // 2: int(rng.random() < (0.9 if c else 0.2)) for i, c in enumerate(clean)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in label.items() for _ in range(1 + i % 3)], "doc_id long, quality int, toxic int")
    model = C.learn(docs, labels)
    used = [i for i in range(n) if zlib.crc32(str(i // 2).encode()) % 5]
    x = C.features(pa.array([texts[i] for i in used], pa.large_string()))
    good, times = np.array([label[i // 2] == 1 for i in used]), np.array([1 + i // 2 % 3 for i in used])
    assert good.sum() > 8000
    n1 = sum(1 + i % 3 for i, q in label.items() if q and zlib.crc32(str(i).encode()) % 5)
    n0 = sum(1 + i % 3 for i, q in label.items() if not q and zlib.crc32(str(i).encode()) % 5)
    whole = C.fit(x, good, n1, n0, times)
    assert np.allclose(model.mean, np.average(x, axis=0, weights=times), rtol=1e-8, atol=1e-12)
    assert np.allclose(model.score(x), whole.score(x), atol=1e-6)


def test_classifier_sample_is_bounded_and_weighted(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(C, "fit", lambda x, good, n1, n0, times=None: got.update(x=x, good=good, n=(n1, n0), times=times))
    # id 1 has 300 texts, id 2 one text 200 times; both are labelled several times
    rows = [(1, f"text {i} " * 9) for i in range(300)] + [(2, "the same text")] * 200 + [(3, "other text"), (4, None)]
    labels = spark.createDataFrame([(1, 1, 0)] * 2 + [(2, 0, 0)] * 3 + [(3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 4))
    C.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, max_per_class=20)
    assert got["good"].sum() == 20 and (~got["good"]).sum() == 3 and got["n"] == (2, 5)
    assert sorted(got["times"][~got["good"]].tolist()) == [1, 1, 600] and set(got["times"][got["good"]].tolist()) == {2}


def test_weighted_fit_is_the_fit_of_repeated_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    good = x @ [2.0, -1, 0] + rng.logistic(size=300) > 0
    times = rng.integers(1, 6, size=300)
    m = C.fit(x, good, int(times[good].sum()), int(times[~good].sum()), times)
    again = np.repeat(np.arange(300), times)
    r = C.fit(x[again], good[again], int(times[good].sum()), int(times[~good].sum()))
    assert np.allclose(m.mean, r.mean) and np.allclose(m.scale, r.scale)
    assert np.allclose(m.weight, r.weight, atol=0.15) and np.allclose(m.score(x), r.score(x), atol=0.06)


def test_classifier_without_labels_or_rows(spark, odd, none, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in C.quality_scores(odd, empty).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 0), (5, None, 1), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in C.quality_scores(odd, one).collect()} == {1.0}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert C.quality_scores(none, labels).count() == 0
    model = C.learn(docs, labels, max_per_class=10)
    assert model.flat is None and np.isfinite(model.score(C.features(pa.array(["", "a b"], pa.large_string())))).all()
