"""Hard negatives against every anchor times every row."""

import math

import numpy as np
import pytest

from cohorta.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, a in use:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in use if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fine = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fine)]
    return sorted(out)


def mined(spark, rows):
    return sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())


def clusters(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = middles[rng.integers(6)] + spread * rng.normal(size=dim)
        out.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], int(rng.integers(10))))
    return out


@pytest.mark.parametrize("spread", [0.4, 1.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "FILE_BLOCKS", 5)
    rows = clusters(900, 12, 1, spread)
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    rows = [(i, [0.5, -0.25, 0.125] if i % 3 == 0 else v, label) for i, v, label in clusters(700, 3, 2)]
    assert mined(spark, rows) == brute(rows)


def test_blocks_are_left_out(spark, monkeypatch):
    """Tight clusters: an anchor reads few blocks, and results stay whole."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 32)
    rows = clusters(3000, 8, 3, 0.02)
    folder, manifest = (H.shared_folder(spark, x) for x in ("test-blocks", "test-manifest"))
    use = H.usable(spark.createDataFrame(rows, SCHEMA))
    curve = H.Curve(np.floor(256 * np.array([v for _, v, _ in rows[:500]])))
    H.write_blocks(H.keyed(use, 8, curve), 8, folder).write.mode("overwrite").parquet(manifest)
    blocks = H.Blocks(folder, manifest)
    one = H.Search(blocks, np.array([100]), np.array([rows[100][2]]), np.floor(256 * np.array([rows[100][1]])))
    one.rows()
    assert blocks.n_blocks >= 90 and 0 < len(blocks.read) < blocks.n_blocks / 2


def test_zones_bound_every_score():
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-300, 300, (40, 6)).astype(float), rng.integers(-300, 300, (7, 6)).astype(float)
    search = H.Search.__new__(H.Search)
    search.kind, search.matrix = float, anchors
    least, most = search.bounds(np.arange(7), rows.min(axis=0)[None], rows.max(axis=0)[None])
    score = anchors @ rows.T
    assert (score >= least).all() and (score <= most).all()


@pytest.mark.parametrize("dim,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dim, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dim)).reshape(dim, -1).T
    key = H.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (3e30 * (1 + i % 5), -2e18 + i * 1e15, 0.37 * i)], i % 3) for i in range(120)]
    got = mined(spark, rows)
    want = [(a, p, k, n, min(s, 2**63 - 1), min(m, 2**63 - 1)) for a, p, k, n, s, m in brute(rows)]
    assert got == sorted(want)


def test_odd_rows(spark):
    rows = clusters(160, 4, 7)
    rows += [(None, [0.1] * 4, 1), (1000, None, 1), (1001, [0.1, None, 0.2, 0.3], 1), (1002, [0.1] * 4, None),
             (1003, [float("nan")] * 4, 2), (1004, [float("inf"), 0.0, 0.0, 0.0], 2), (1005, [], 3), (1006, [0.9, 0.1], 3),
             (1050, [0.4, 0.5, 0.1, 0.2], 3), (1007, [0.4, 0.5, 0.1, 0.2], 2147483647)]
    rows += [rows[3]] * 3 + [rows[50]] * 2                 # repeated rows, an anchor among them
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 50]) == []
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "vector", "salt", "rank"):
        df = df.selectExpr("*", f"'clash' as {name}")
    assert sorted(tuple(r) for r in H.hard_negatives(df).collect()) == brute(rows)


def test_empty_table(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
