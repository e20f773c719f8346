"""Quality scores by Bradley-Terry pairwise ranking (operator 6).

A document's strength is linear in its text features.  A document labelled 1
is preferred over one labelled 0; logistic loss on the feature differences of
all such pairs is minimised by Newton's method.  The cut is the quantile of the
training strengths that leaves out the share labelled 0, and scores are
scaled so that this quantile has score ``CUT_SCORE``.

Fitting covers every labelled text that is not held out and every pair of them.
Each weighs as often as it occurs, times the labels of its id.  Whole texts are
counted once, for the fit and the scores; rounds of the fit read these counts.
``max_per_class`` fits a sample instead: at most so many ids and then as many
(id, text) of each class, in the order of a hash.

Rows in, defined results: null and empty texts get the score of a text
without words; null or other labels than 0 and 1 are not learned from; a
doc_id labelled twice counts as often; without both classes every score is
the share labelled 1 (0.5 without labels); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.quality_rules import vector
from cohorta.llm.scratch import counted, stored, tasks_for
from cohorta.llm.textstats import FIELDS, counts
from cohorta.llm.tokens import slices, text_column

RIDGE = 1e-3
CUT_SCORE = 0.3
#: Width of a bin of strengths, and terms of the series about its centre.
BIN = 0.25
TERMS = 14
#: Parts into which the search for the cut divides a bin.
PARTS = 1024
#: A distinct labelled text: hash and bytes stand for the text.
KEY = ["doc_id", "quality", "hash", "size"]


def features(texts: pa.Array) -> np.ndarray:
    """Rows of transformed statistics, their squares and the log length."""
    return of_counts(counts(texts))


def of_counts(c: dict[str, np.ndarray]) -> np.ndarray:
    """``features`` of texts with these counts."""
    x, _ = vector(c)
    size = np.log1p(c["n_words"].astype(np.float64))
    lines = np.log1p(c["n_lines"].astype(np.float64))
    again = np.arcsin(np.sqrt(c["n_again"] / np.maximum(c["n_words"], 1)))
    return np.column_stack([x, x * x, np.sqrt(np.abs(x[:, :7])), size, size * size, lines, again, np.sqrt(again)])


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float
    flat: float | None       # the one score if nothing could be learned

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        s = np.einsum("ij,j->i", (x - self.mean) / self.scale, self.weight)
        z = self.slope * (s - self.cut) + math.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def newton(step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, rounds: int = 40) -> np.ndarray:
    """Where the gradient vanishes; ``step`` gives it and the curvature at a point."""
    b = np.zeros(n)
    for _ in range(rounds):
        grad, hess = step(b)
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        b += move
        if np.abs(move).max() < 1e-7:
            break
    return b


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _derivatives(n: int) -> list[np.ndarray]:
    """Polynomials in y that give the first ``n`` derivatives of y = logistic(z), over their factorials."""
    out = [np.array([0.0, 1.0])]
    for k in range(1, n):
        out.append(np.polynomial.polynomial.polymul(np.polynomial.polynomial.polyder(out[-1]), [0, 1, -1]) / k)
    return out


SERIES = _derivatives(TERMS)


class Curve(NamedTuple):
    """t -> sum of w * logistic(sign * (t - s)) over rows (s, w): a polynomial about the centre of each bin of ``at``."""
    at: np.ndarray           # bins, ascending
    terms: np.ndarray        # bins x TERMS
    slope: np.ndarray        # size of the derivative, taking every row for the centre of its bin

    def of(self, s: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, binned slopes) at ``s``."""
        k, e = np.searchsorted(self.at, bins), s - (bins + 0.5) * BIN
        value = np.zeros(len(s))
        for m in range(TERMS - 1, -1, -1):
            value = value * e + self.terms[k, m]
        return value, self.slope[k]


def curve(at: np.ndarray, bins: np.ndarray, moments: np.ndarray, sign: int) -> Curve:
    """The curve at the bins ``at`` of rows whose sums of w * (s - centre)^k by bin are ``moments``.

    Two offsets differ by a bin at most, where the series of the logistic function, whose nearest pole is pi away, has
    converged to the last digits of a double."""
    terms, slope = np.zeros((len(at), TERMS)), np.zeros(len(at))
    for low in range(0, len(at), 256):
        gap = sign * (at[low:low + 256, None] - bins[None, :]) * BIN
        y = logistic(gap)
        slope[low:low + 256] = (y * (1 - y)) @ moments[:, 0]
        for n, p in enumerate(SERIES):
            f = np.polynomial.polynomial.polyval(y, p) * sign ** n
            for m in range(n + 1):
                terms[low:low + 256, m] += math.comb(n, m) * (-1) ** (n - m) * (f @ moments[:, n - m])
    return Curve(at, terms, slope)


#: What a pass over the rows adds up: (tag, keys, values of each key) of some rows (features, label 1 or not, times).
Sums = dict[int, tuple[np.ndarray, np.ndarray]]
Part = list[tuple[int, np.ndarray, np.ndarray]]
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], Part]
Total = Callable[[Kernel], Sums]


def add_up(parts: Part) -> Sums:
    """One row of values for each key of a tag."""
    out = {}
    for tag in {t for t, _, _ in parts}:
        keys, at = np.unique(np.concatenate([k for t, k, _ in parts if t == tag]), return_inverse=True)
        values = np.concatenate([v for t, _, v in parts if t == tag])
        total = np.zeros((len(keys), values.shape[1]))
        np.add.at(total, at, values)
        out[tag] = keys, total
    return out


def _one(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, np.int64), np.asarray(v, float).reshape(1, -1)


def _short(v: np.ndarray) -> np.ndarray:
    """Nine digits, which do not depend on the order in which tasks end."""
    return np.array([float(f"{x:.9g}") for x in v])


def bins_of(s: np.ndarray) -> np.ndarray:
    return np.floor(s / BIN).astype(np.int64)


def weights(total: Total, mean: np.ndarray, scale: np.ndarray, sums: tuple[float, float]) -> np.ndarray:
    """Ridge Bradley-Terry fit over every pair of a row labelled 1 and a row labelled 0.

    A pair adds a function of the difference of two strengths.  Strengths are numbers, so what all rows of the other
    label add to a row is a smooth curve of its strength, known to the last digits from sums by bin of strength: a
    pass for these sums, another for the gradient over all pairs.  The curvature takes rows for the centres of their
    bins, which makes it no less positive and costs a round at most."""
    def step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def moments(x: np.ndarray, good: np.ndarray, times: np.ndarray) -> Part:
            s = ((x - mean) / scale) @ b
            k = bins_of(s)
            powers = (s - (k + 0.5) * BIN)[:, None] ** np.arange(TERMS) * (times / np.where(good, *sums))[:, None]
            return [(int(g), k[good == g], powers[good == g]) for g in (True, False)]

        found = total(moments)
        (above, m1), (below, m0) = found[1], found[0]
        # of rows labelled 1: how far those labelled 0 come over them; of these: how far they come over the others
        curves = {True: curve(above, below, m0, -1), False: curve(below, above, m1, 1)}

        def slopes(x: np.ndarray, good: np.ndarray, times: np.ndarray) -> Part:
            z = (x - mean) / scale
            s = z @ b
            k, w = bins_of(s), times / np.where(good, *sums)
            parts: Part = []
            for g in (True, False):
                own = good == g
                value, bend = curves[g].of(s[own], k[own])
                parts += [(2, *_one((w[own] * value) @ z[own] * (1 if g else -1))),
                          (3, *_one((z[own] * (w[own] * bend)[:, None]).T @ z[own])),
                          (4 + int(g), k[own], z[own] * w[own][:, None])]
            return parts

        found = total(slopes)
        (k0, z0), (k1, z1) = found[4], found[5]
        y = logistic((k1[:, None] - k0[None, :]) * BIN)
        cross = z1.T @ (y * (1 - y)) @ z0
        hess = found[3][1].reshape(len(b), -1) - cross - cross.T + RIDGE * np.eye(len(b))
        return found[2][1][0] - RIDGE * b, hess

    return newton(step, len(mean))


def quantile(total: Total, strength: Callable[[np.ndarray], np.ndarray], share: float, scaled: tuple[float, float]) -> float:
    """The least strength up to which rows have ``share`` of all weight; ``scaled``: weight of a row labelled 1 and 0.

    One pass each for the bin that holds it, a part of that bin, a part of that part, and the strengths in this."""
    ends: list[tuple[float, float]] = []         # (start, width of a part) of each level but the last

    def parts_of(s: np.ndarray, level: int) -> np.ndarray:
        low, width = ends[level]
        return np.clip(np.floor((s - low) / width), 0, PARTS - 1).astype(np.int64)

    below, level, chosen = 0.0, 0, []
    while True:
        def held(x: np.ndarray, good: np.ndarray, times: np.ndarray, level: int = level) -> Part:
            s = strength(x)
            at = np.ones(len(s), bool) if not chosen else bins_of(s) == chosen[0]
            for i, part in enumerate(chosen[1:]):
                at &= parts_of(s, i) == part
            s, w = s[at], (times * np.where(good, *scaled))[at]
            keys = bins_of(s) if level == 0 else s.view(np.int64) if level == 3 else parts_of(s, level - 1)
            return [(0, keys, w[:, None])]

        keys, w = total(held)[0]
        order = np.argsort(keys.view(float) if level == 3 else keys)
        upto = below + np.cumsum(w[order, 0])
        if level == 0:
            goal = share * upto[-1] - 1e-12 * upto[-1]
        k = min(int(np.searchsorted(upto, goal)), len(order) - 1)
        below = upto[k - 1] if k else below
        if level == 3:
            return float(keys.view(float)[order[k]])
        chosen.append(int(keys[order[k]]))
        low, width = (chosen[0] * BIN, BIN) if level == 0 else (ends[-1][0] + chosen[-1] * ends[-1][1], ends[-1][1])
        ends.append((low, width / PARTS))
        level += 1


def solve(total: Total, n_good: int, n_bad: int) -> Model:
    """Bradley-Terry fit over all pairs of the rows that ``total`` adds up; n_good, n_bad: labelled rows in all."""
    def sizes(x: np.ndarray, good: np.ndarray, times: np.ndarray) -> Part:
        return [(0, *_one(np.append(times @ x, [times[good].sum(), times[~good].sum()])))]

    found = total(sizes).get(0)
    t1, t0 = found[1][0, -2:] if found else (0.0, 0.0)
    if not t1 or not t0:
        share = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 0.0, share)
    mean = _short(found[1][0, :-2] / (t1 + t0))
    spread = total(lambda x, good, times: [(0, *_one(times @ (x - mean) ** 2))])[0][1][0]
    scale = _short(np.maximum(np.sqrt(spread / (t1 + t0)), 1e-6))
    w = _short(weights(total, mean, scale, (float(t1), float(t0))))

    def strength(x: np.ndarray) -> np.ndarray:
        # each row on its own: equal rows have equal strengths, whatever stands beside them
        return np.einsum("ij,j->i", (x - mean) / scale, w)

    scaled = (n_good / t1, n_bad / t0)
    cut = quantile(total, strength, n_bad / (n_good + n_bad), scaled)

    def step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def fall(x: np.ndarray, good: np.ndarray, times: np.ndarray) -> Part:
            one = np.column_stack([strength(x) - cut, np.ones(len(x))])
            p, own = logistic(one @ b), times * np.where(good, *scaled) / (n_good + n_bad)
            bend = (one * (own * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ one
            return [(0, *_one(np.append((own * (good - p)) @ one, bend)))]

        got = total(fall)[0][1][0]
        return got[:2] - 1e-4 * b, got[2:].reshape(2, 2) + 1e-4 * np.eye(2)

    return Model(mean, scale, w, cut, float(max(newton(step, 2)[0], 1e-3)), None)


def fit(x: np.ndarray, good: np.ndarray, n_good: int, n_bad: int, times: np.ndarray | None = None) -> Model:
    """Bradley-Terry fit of labelled feature rows that occur ``times`` times; n_good, n_bad: labelled rows in all."""
    times = np.ones(len(x), np.int64) if times is None else times
    return solve(lambda kernel: add_up(kernel(x, good, times)), n_good, n_bad)


def fit_table(rows: DataFrame, n_good: int, n_bad: int) -> Model:
    """``fit`` of a stored table (quality, times, counts of a text): every pass is a Spark job.  Tasks add up their
    rows and Spark adds up the tasks; the sums that come to the driver do not grow with the rows."""
    def total(kernel: Kernel) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Sums = {}
            for batch in batches:
                parts = kernel(of_counts({k: batch.column(k).to_numpy() for k in FIELDS}),
                               batch.column("quality").to_numpy() == 1, batch.column("times").to_numpy().astype(float))
                sums = add_up([*((t, *kv) for t, kv in sums.items()), *parts])
            for tag, (keys, values) in sums.items():
                n, width = values.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * width, tag)), pa.array(np.repeat(keys, width)),
                     pa.array(np.tile(np.arange(width), n)), pa.array(values.ravel())], ["tag", "key", "place", "value"])

        got = (rows.mapInArrow(run, "tag long, key long, place long, value double")
               .groupBy("tag", "key", "place").agg(F.sum("value").alias("value")).toArrow())
        got = got.sort_by([(k, "ascending") for k in ("tag", "key", "place")])
        tag, key, value = (got.column(k).to_numpy() for k in ("tag", "key", "value"))
        out = {}
        for t in np.unique(tag).tolist():
            keys = np.unique(key[tag == t])
            out[t] = keys, value[tag == t].reshape(len(keys), -1)
        return out

    return solve(total, n_good, n_bad)


def held_out() -> Column:
    """crc32 of the id as text leaves 0 modulo 5 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                c = counts(text_column(piece))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in FIELDS)],
                                                 ["doc_id", *FIELDS])

    return stored(rows.mapInArrow(measure, "doc_id long, " + ", ".join(f"{k} long" for k in FIELDS)), "quality-counts")


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int | None = None, texts: DataFrame | None = None) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out; ``texts``: their ``measured`` counts, if at hand."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    good = good.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    good = stored(good.groupBy("doc_id", "quality").agg(F.count("*").alias("labels")), "quality-labels")
    n = {r.quality: r.n for r in good.groupBy("quality").agg(F.sum("labels").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if max_per_class is None:
        texts = measured(docs) if texts is None else texts
        rows, n_rows = counted(texts.join(good, "doc_id").select("quality", F.col("labels").alias("times"), *FIELDS), "quality-rows")
        return fit_table(rows.coalesce(tasks_for(n_rows)), n1, n0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids and texts by hash, at most max_per_class rows of a few numbers a class: a proven bound
    ids = _first(good, max_per_class, "doc_id")
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(-1))})
    times = stored(keyed.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "hash", "size")
                   .agg(F.sum("labels").alias("times")), "quality-texts")
    sample = F.broadcast(_first(times, max_per_class, "doc_id", "hash", "size"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # equal texts of an id are measured once a batch
            keys = pa.table([*(batch.column(k) for k in KEY), pa.array(np.arange(batch.num_rows))], [*KEY, "row"])
            firsts = keys.group_by(KEY).aggregate([("row", "min")]).column("row_min").combine_chunks()
            for piece in slices(batch.take(firsts)):
                x = features(text_column(piece))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(k) for k in KEY), piece.column("times"),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                              pa.array(x.ravel()))], [*KEY, "times", "x"])

    got = (keyed.join(sample, ["doc_id", "hash", "size"]).mapInArrow(
        measure, "doc_id long, quality int, hash long, size int, times long, x array<double>")
        .groupBy(*KEY).agg(F.first("times").alias("times"), F.first("x").alias("x")).toArrow())
    got = got.sort_by([(k, "ascending") for k in KEY])
    label = got.column("quality").to_numpy() == 1
    x = np.array(got.column("x").to_pylist(), float).reshape(len(label), -1 if len(label) else 1)
    return fit(x, label, n1, n0, got.column("times").to_numpy())


def _first(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The first ``n`` rows of each class in the order of a hash of the key."""
    order = [F.xxhash64(*key, F.lit("quality")), *key]
    return rows.filter("quality = 1").orderBy(*order).limit(n).union(rows.filter("quality = 0").orderBy(*order).limit(n))


def quality_scores(docs: DataFrame, labels: DataFrame, max_per_class: int | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = measured(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_per_class, texts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = model.score(of_counts({k: batch.column(k).to_numpy() for k in FIELDS}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= CUT_SCORE).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return (texts.mapInArrow(score, "doc_id long, score double, predicted int")
            .select("doc_id", held_out().alias("held_out"), "score", "predicted"))
