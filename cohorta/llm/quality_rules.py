"""Quality rules with robust multivariate outliers (operator 3).

Base rule: fewer than 10 words, or over 20 % of the words in repeated
five-word windows.  Beyond it, the minimum covariance determinant (MCD) of a
transformed statistic vector is estimated for each language and source, and
documents far from it by Mahalanobis distance are rejected.

The MCD runs on Spark.  A concentration step scores every row, sums first
and second moments by group and distance bucket inside the tasks, adds them
up, and takes the nearest buckets until they hold the ``support`` share; the
mean and covariance of those rows are the next step's.  Hot groups are summed
before the shuffle and no group is ever gathered.  Two deterministic starts
are run side by side and the smaller determinant wins.  Groups below
``min_rows`` use their language's estimate, then that of all documents; with
fewer than ``min_rows`` documents in all nothing beyond the base rule is
rejected.

Rows in, defined results: a null text has no words and fails the base rule; a
null lang or source is a group of its own; repeated rows get equal verdicts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored
from cohorta.llm.textstats import FIELDS, counts
from cohorta.llm.tokens import slices, text_column

#: name, floor of its standard deviation (so that a statistic that is constant
#: in a group does not reject the first document that differs a little)
STATS = (("symbols", .06), ("upper", .08), ("digits", .08), ("bare", .08),
         ("ends", .12), ("dup_lines", .20), ("repeats", .12), ("word_length", .12))
P = len(STATS)
FLOOR2 = np.array([s * s for _, s in STATS])
BASE = FIELDS[:5]

SUPPORT = 0.6
STEPS = 5
MIN_ROWS = 60
#: Rejected beyond this chi-square quantile of the squared distance.
CUT_TAIL = 1e-9
BUCKETS_PER_OCTAVE = 8
N_MOMENTS = P + P * (P + 1) // 2
_TRI = np.triu_indices(P)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function (series of the incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    if z > a + 40 + 10 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_tail(x: float, k: int) -> float:
    """1 - cdf for even ``k``, exact also far out."""
    z, term, total = x / 2, 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= z / (i + 1)
    return math.exp(-z) * total


def solve(f, target: float, low: float, high: float) -> float:
    """Where the monotone ``f`` crosses ``target``."""
    up = f(high) > f(low)
    for _ in range(200):
        mid = (low + high) / 2
        if (f(mid) < target) == up:
            low = mid
        else:
            high = mid
    return (low + high) / 2


#: The covariance of the nearest share underestimates that of all rows by this factor.
CONSISTENCY = SUPPORT / chi2_cdf(solve(lambda x: chi2_cdf(x, P), SUPPORT, 0, 100), P + 2)
CUT = solve(lambda x: chi2_tail(x, P), CUT_TAIL, 0, 500)


def vector(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Transformed statistics (rows x P) and their sampling variances.

    Shares become angles asin(sqrt(p)) with variance 1/4n over words (over
    lines for lines), so that short clean texts are judged by what chance
    allows; word length becomes its logarithm.
    """
    f = {k: v.astype(np.float64) for k, v in c.items()}
    n = np.maximum(f["n_words"], 1)
    chars = np.maximum(f["word_chars"], 1)

    def angle(a, b):
        return np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))

    x = np.stack([angle(f["n_symbols"], chars), angle(f["n_upper"], f["n_letters"]), angle(f["n_digits"], chars),
                  angle(f["n_bare"], n), angle(f["n_ends"], n), angle(f["n_dup_lines"], f["n_lines"]),
                  angle(f["n_repeat_words"], n), np.log(chars / n)], axis=1)
    v = np.repeat((0.25 / n)[:, None], P, axis=1)
    v[:, 5] = 0.25 / np.maximum(f["n_lines"], 1)
    v[:, 7] = 0.36 / n
    return x, v


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def distance2(x: np.ndarray, noise: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances under the covariance plus each row's own noise."""
    if not len(x):
        return np.zeros(0)
    full = cov.copy()
    full[:, np.arange(P), np.arange(P)] += FLOOR2 + noise
    d = x - mean
    return np.einsum("ij,ij->i", d, np.linalg.solve(full, d[:, :, None])[:, :, 0])


def measure(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """Counts of every document with doc_id, group keys and, if asked, the row as ``doc``."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = docs.select(*cols)
    kept = [c for c in rows.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                c = counts(text_column(piece))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(k) for k in kept] + [pa.array(c[k].astype(np.int64)) for k in FIELDS],
                    [*kept, *FIELDS])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(count, schema + "".join(f", {k} long" for k in FIELDS))


def level_key(level: int) -> Column:
    """Key of a row's group: 0 language and source, 1 language, 2 everything."""
    part = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in ("lang", "source")[:2 - level]]
    return F.concat_ws("\x1f", F.lit(str(level)), *part)


def _batch_counts(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: b.column(k).to_numpy(zero_copy_only=False) for k in FIELDS}


def _lists(b: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, *shape)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (1, x, xx') by group, start and distance bucket within the task."""
    total: dict[tuple[str, int, int], np.ndarray] = {}

    def drain():
        keys = list(total)
        values = np.array([total[k] for k in keys])
        total.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.int32()), *(pa.array(values[:, i]) for i in range(N_MOMENTS + 1))],
            ["key", "start", "bucket", *(f"m{i}" for i in range(N_MOMENTS + 1))])

    for b in batches:
        if not b.num_rows:
            continue
        x, noise = vector(_batch_counts(b))
        keys, code = np.unique(b.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        mean, cov = _lists(b, "mean", 2, P), _lists(b, "cov", 2, P, P)
        full = np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :])[:, _TRI[0], _TRI[1]]], axis=1)
        for s in (0, 1):
            d = distance2(x, noise, mean[:, s], cov[:, s])
            bucket = np.clip(np.ceil(np.log2(np.maximum(d, 2.0 ** -8)) * BUCKETS_PER_OCTAVE), -64, 160).astype(np.int64)
            slot, where = np.unique(code * 1000 + bucket + 64, return_inverse=True)
            sums = np.zeros((len(slot), N_MOMENTS + 1))
            np.add.at(sums, where, full)
            for k, row in zip(slot.tolist(), sums):
                ident = (str(keys[k // 1000]), s, k % 1000)
                total[ident] = total[ident] + row if ident in total else row
        if len(total) > 20_000:
            yield drain()
    if total:
        yield drain()


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Next estimate of one group from its buckets (a few hundred rows at most)."""
    means, covs, dets = [], [], []
    n_all = 0.0
    for s in (0, 1):
        own = pdf[pdf.start == s].sort_values("bucket")
        m = own[[f"m{i}" for i in range(N_MOMENTS + 1)]].to_numpy()
        n = np.cumsum(m[:, 0])
        n_all = n[-1]
        last = int(np.searchsorted(n, math.ceil(SUPPORT * n[-1]) - 1e-9))
        t = m[:last + 1].sum(axis=0)
        mean = t[1:P + 1] / t[0]
        second = np.zeros((P, P))
        second[_TRI] = t[P + 1:] / t[0]
        second = second + np.triu(second, 1).T
        cov = (second - np.outer(mean, mean)) * CONSISTENCY
        # rounding may leave tiny negative values
        value, vec = np.linalg.eigh((cov + cov.T) / 2)
        cov = (vec * np.maximum(value, 0)) @ vec.T
        means.append(mean)
        covs.append(cov)
        dets.append(float(np.linalg.slogdet(cov + np.diag(FLOOR2))[1]))
    return pd.DataFrame({"key": [pdf.key.iloc[0]], "n": [int(round(n_all))],
                         "mean": [np.concatenate(means).tolist()],
                         "cov": [np.concatenate([c.ravel() for c in covs]).tolist()], "logdet": [dets]})


PARAMS = "key string, n long, mean array<double>, cov array<double>, logdet array<double>"


def estimates(measured: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """lang, source -> mean, cov of the estimate that judges the group.

    The result has one row per (lang, source); it is joined, not collected.
    """
    ok = measured.filter("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    sizes = ok.groupBy("lang", "source").agg(F.count("*").alias("n0"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n0").alias("n1"))
    groups = (measured.select("lang", "source").distinct().alias("g")
              .join(sizes.alias("s"), F.col("g.lang").eqNullSafe(F.col("s.lang"))
                    & F.col("g.source").eqNullSafe(F.col("s.source")), "left")
              .select("g.lang", "g.source", "n0").alias("g")
              .join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
              .select("g.lang", "g.source", "n0", "n1"))
    groups = stored(groups.withColumn(
        "key", F.when(F.col("n0") >= min_rows, level_key(0)).when(F.col("n1") >= min_rows, level_key(1))
        .otherwise(level_key(2))), "mcd-groups")
    wanted = groups.select("key").distinct()

    rows = (ok.select("lang", "source", *FIELDS)
            .withColumn("key", F.explode(F.array(level_key(0), level_key(1), level_key(2))))
            .drop("lang", "source").join(wanted, "key", "left_semi"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = vector(_batch_counts(b))
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(x[:, i]) for i in range(P))],
                                             ["key", *(f"x{i}" for i in range(P))])

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        """Medians with quartile spreads, and medians with the floors alone."""
        out = []
        for r in pdf.itertuples(index=False):
            q = np.array([getattr(r, f"q{i}") for i in range(P)])
            q = np.round(q * 256) / 256
            spread = np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)
            out.append((r.key, 0, np.concatenate([q[:, 1], q[:, 1]]).tolist(),
                        np.concatenate([spread.ravel(), np.zeros(P * P)]).tolist(), [0.0, 0.0]))
        return pd.DataFrame(out, columns=["key", "n", "mean", "cov", "logdet"])

    quartiles = (rows.mapInArrow(stats, "key string" + "".join(f", x{i} double" for i in range(P)))
                 .groupBy("key").agg(*[F.percentile_approx(f"x{i}", [.25, .5, .75], 5000).alias(f"q{i}")
                                       for i in range(P)]))
    params = stored(quartiles.mapInPandas(lambda it: (start(p) for p in it if len(p)), PARAMS), "mcd-start")
    moment_schema = "key string, start int, bucket int" + "".join(f", m{i} double" for i in range(N_MOMENTS + 1))
    for _ in range(steps):
        scored = rows.join(params.select("key", "mean", "cov"), "key")
        sums = (scored.mapInArrow(_moments, moment_schema).groupBy("key", "start", "bucket")
                .agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(N_MOMENTS + 1)]))
        params = stored(sums.groupBy("key").applyInPandas(_concentrate, PARAMS), "mcd-step")

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                s = 1 if r.logdet[1] < r.logdet[0] - 1e-9 else 0
                out.append((r.key, r.n, list(r.mean[s * P:(s + 1) * P]), list(r.cov[s * P * P:(s + 1) * P * P])))
            yield pd.DataFrame(out, columns=["key", "n", "mean", "cov"])

    final = params.mapInPandas(best, "key string, n long, mean array<double>, cov array<double>")
    # written, so that its size is known and the rows it is joined to need not move when it is small
    return stored(groups.select("lang", "source", "key").join(final.filter(F.col("n") >= min_rows), "key", "left"),
                  "mcd-final")


def judge(measured: DataFrame, params: DataFrame, cut: float = CUT) -> DataFrame:
    """``measured`` with base_failed, distance (null if not estimated) and kept."""
    m, g = measured.alias("m"), params.alias("g")
    joined = (m.join(g, F.col("m.lang").eqNullSafe(F.col("g.lang"))
                     & F.col("m.source").eqNullSafe(F.col("g.source")), "left")
              .select("m.*", F.col("g.mean").alias("_mean"), F.col("g.cov").alias("_cov")))
    kept = measured.columns

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _batch_counts(b)
            x, noise = vector(c)
            failed = base_failed(c)
            d = np.full(b.num_rows, np.nan)
            has = b.column("_mean").is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                some = b.filter(pa.array(has))
                d[has] = distance2(x[has], noise[has], _lists(some, "_mean", P), _lists(some, "_cov", P, P))
            with np.errstate(invalid="ignore"):
                keep = ~failed & ~(d > cut)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in kept), pa.array(failed), pa.array(d, mask=np.isnan(d)), pa.array(keep)],
                [*kept, "base_failed", "distance", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema)
    return joined.mapInArrow(verdict, schema + ", base_failed boolean, distance double, kept boolean")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document with the base counts, base_failed, kept and its squared distance."""
    measured = stored(measure(docs), "quality-counts")
    return judge(measured, estimates(measured)).select("doc_id", *BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    measured = stored(measure(docs, keep_row=True), "quality-rows")
    return judge(measured, estimates(measured.drop("doc"))).filter("kept").select("doc.*")
