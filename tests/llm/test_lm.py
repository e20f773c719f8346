"""Backoff automaton against direct evaluation of the smoothed n-gram formula."""

import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohorta.llm import lm_scoring as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, order, mu):
    """{row number: (n_tokens, n_known, N, base, score)} by the formula."""
    runs = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</e>"] for _, t in rows]
    train = [r for (i, _), r in zip(rows, runs) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(tuple(r[p - k + 1:p + 1]) for r in train for k in range(1, order + 1) for p in range(k - 1, len(r)))
    total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    kinds = sum(1 for g in count if len(g) == 1 and g != ("<s>",))

    def p(g):
        if len(g) == 1:
            return (count[g] + 0.5) / (total + 0.5 * (kinds + 1))
        return (count[g] + mu * p(g[1:])) / (count[g[:-1]] + mu)

    out = []
    for r in runs:
        base = sum(math.log10(p((w,))) for w in r[1:])
        score = sum(math.log10(p(tuple(r[max(0, i - order + 1):i + 1]))) for i in range(1, len(r)))
        out.append((len(r) - 1, sum(count[(w,)] > 0 for w in r[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order,mu,chunk", [(2, 400.0, 60_000), (3, 30.0, 20_000), (2, 5.0, 12 << 20),
                                            (M.ORDER, M.MU, 40_000)])
def test_scores_equal_the_formula(spark, docs, order, mu, chunk, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_BYTES", chunk)       # several chunks: counts must travel
    monkeypatch.setattr(M, "BUCKET_TOKENS", 20_000)
    some = docs.select("doc_id", "text").limit(120)
    rows = [(r.doc_id, r.text) for r in some.collect()]
    want = {i: w for (i, _), w in zip(rows, direct(rows, order, mu))}
    for r in M.score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order, mu).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_counts_beyond_32_bits_are_exact():
    hashes = [np.array([11, 22, 33], np.uint64), np.array([44, 11], np.uint64), np.array([33, 11], np.uint64)]
    counts = [[4_000_000_000, 5, 2**31 - 2], [2**31 - 1, 4_000_000_000], [0, 4_000_000_000]]
    table = pa.table({"bucket": [0] * 3, "chunk": [0, 1, 2], "hashes": [h.tobytes() for h in hashes],
                      "counts": [np.array(c, "<u4").tobytes() for c in counts]})
    replies = M._merge(table).to_pylist()
    got = []
    for reply, h in zip(replies, hashes):
        row = {"sizes": [len(h)], "held": [False], "tokens": np.arange(len(h), dtype="<u4").tobytes(), "hashes": h.tobytes()}
        c = M.Chunk(row)
        level = c.levels[0]
        c.levels[0] = level = M.Level(level.count[:-1], level.hashes[:-1], level.context, level.suffix, level.word[:-1])
        c.answer(level, [reply], 1)
        got.append((level.total.tolist(), level.shared.tolist()))
    assert got == [([12_000_000_000, 5, 2**31 - 2], [True, False, True]), ([2**31 - 1, 12_000_000_000], [False, True]),
                   ([2**31 - 2, 12_000_000_000], [True, True])]
    assert replies[0]["n_total"] == 12_000_000_000 + 5 + 2**31 - 2 + 2**31 - 1


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 5000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        for buckets in (1, 4, 51):
            for own in (h, np.sort(h)):
                own = own[own % np.uint64(buckets) == buckets - 1]
                assert (M.unpack_hashes(M.pack_hashes(own, buckets), buckets - 1, buckets) == own).all()
        few = rng.integers(0, 5, n).astype("<u4")
        assert (M.expanded(M.squeezed(few), "<u4") == few).all()
    assert len(M.squeezed(few)) < 0.2 * few.nbytes


def test_odd_rows(odd, none):
    rows = M.score_corpus(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert all(r.n_tokens == 1 for r in empty) and len({r.score for r in empty}) == 1
    assert all(r.base_score <= 0 and r.score <= 0 for r in rows)
    assert M.score_corpus(none).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = M.score_corpus(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.train_tokens, r.n_known, r.base_score) == (True, 0, 0, 0.0) and r.score == 0.0


def _batch(chunks, replies):
    """Chunks of (tokens, word hashes) as a task gets them: one batch, with the answers so far."""
    kind = pa.list_(pa.struct([("order", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("large", pa.binary())]))
    size = [[len(t) // 4] * 4 for t, _ in chunks]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(chunks)), pa.int64()), pa.array([[1, 2, 3, 4]] * len(chunks), pa.list_(pa.int64())),
         pa.array([[False, True, False, False]] * len(chunks), pa.list_(pa.bool_())), pa.array(size, pa.list_(pa.int64())),
         pa.array([t.astype("<u4").tobytes() for t, _ in chunks], pa.binary()),
         pa.array([h.tobytes() for _, h in chunks], pa.binary()), pa.array([len(t) for t, _ in chunks]),
         pa.array([replies.get(i) for i in range(len(chunks))], kind)],
        ["chunk", "doc_ids", "held", "sizes", "tokens", "hashes", "n_tokens", "replies"])


def _most(function, batch):
    """(what it yields, most bytes that it held beside the batch)."""
    tracemalloc.start()
    try:
        out = [b.to_pylist() for b in function(iter([batch]))]
        return sum(out, []), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_holds_one_chunk_at_a_time_in_little_memory():
    rng = np.random.default_rng(7)
    buckets, n_tokens = 3, 200_000
    chunks = [(np.minimum(rng.zipf(1.3, n_tokens) - 1, 19_999), M.mix(np.arange(20_000, dtype=np.uint64))) for _ in range(3)]
    replies, sent = {}, 0
    for k in range(1, M.ORDER + 1):
        rows, most = _most(M._sender(k, buckets), _batch(chunks, replies))
        sent = max(sent, most)
        for b in range(buckets):
            own = [r for r in rows if r["bucket"] == b]
            for r in M._merger(buckets)(pa.Table.from_pylist(own)).to_pylist():
                replies.setdefault(r["chunk"], []).append({"order": k, **{x: r[x] for x in ("bucket", "counts", "large")}})
    scored, most = _most(M._scorer(M.ORDER, buckets, 450_000, 20_000, M.MU), _batch(chunks, replies))
    assert len(scored) == 12 and all(math.isfinite(r["score"]) and r["n_tokens"] == n_tokens // 4 for r in scored)
    # bytes a token of one chunk; before: 178 to send and 233 to score
    assert sent < 110 * n_tokens and most < 110 * n_tokens
