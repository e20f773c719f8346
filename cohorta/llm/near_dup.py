"""Near duplicates by BagMinHash signatures of five-word shingle multisets (operator 4).

A text is the multiset of its five-word shingles (a text of one to four words
is one shingle).  Weights are cut into dyadic blocks (0,1], (1,2], (2,4], ...;
each (shingle, block) is a Poisson process over time, block position and
signature component, read point by point until it is later than the whole
signature.  A point counts if its position lies below the shingle's weight,
so two signatures agree in a component with probability equal to the weighted
Jaccard similarity.  Signatures are banded, candidates of a band are verified
on their whole texts by exact multiset overlap, and links are joined into
classes.

No bucket is paired with itself.  Equal texts are one node.  Each member of a
bucket is checked against one pivot, the member that shares most buckets with
others, which is the original rather than one of its copies.  Texts of buckets
that still span components then go through an exact prefix-filter join on
their shingles, which meets only pairs that may reach the threshold and lie
in different components.
Pairs inside a component are linked already, so no link is lost.

Rows in, defined results: texts without a word (null, empty) are classes of
their own; repeated rows and equal word sequences share a class; class_id is
the least doc_id of the class (null if none has an id); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.components import components
from cohorta.llm.scratch import LEAST_TASKS, counted, stored, tasks_for
from cohorta.llm.tokens import hash_strings, mix, slices, text_column, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
COMPONENTS = BANDS * ROWS
#: Candidates agreeing in fewer components are dropped unread: a pair at the
#: threshold falls below it with a chance of 3e-11, far less than that of sharing no band.
LEAST_AGREEING = 85
#: Cells that wanted texts are marked in before they are joined.
CELLS = 1 << 22
#: Tokens looked at to tell frequent ones (only the speed depends on it).
SAMPLE_TOKENS = 1_000_000
_G = np.uint64(0x9E3779B97F4A7C15)
_TIME = 2.0 ** 44
_NEVER = np.int64(2 ** 62)


def shingles(w, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of all shingles; a shorter text is one shingle."""
    h = hash_strings(w.vocab)[w.ids] if len(w.vocab) else np.zeros(0, np.uint64)
    key, off = windows(h, w.offsets, k)
    n = w.counts
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return key, off
    whole = np.empty(len(short), np.uint64)
    for j, i in enumerate(short):
        whole[j] = windows(h[w.offsets[i]:w.offsets[i + 1]], np.array([0, n[i]]), int(n[i]))[0][0] ^ np.uint64(n[i])
    key = np.insert(key, off[short], whole)
    return key, off + np.concatenate([[0], np.cumsum((n > 0) & (n < k))])


def bag(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, weight) of each distinct shingle of each document."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
    return d[edge], k[edge], np.diff(np.append(edge, len(k)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int,
               m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (documents x m): the earliest accepted point of each component."""
    sig = np.full(n_docs * m, _NEVER, np.int64)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)      # last block used
    row = np.repeat(np.arange(len(key)), top + 1)
    block = np.arange(len(row)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    length = np.where(block == 0, 1, 2 ** np.maximum(block - 1, 0)).astype(np.float64)
    low = np.where(block == 0, 0, length)
    with np.errstate(over="ignore"):
        seed = mix(key[row] ^ mix((block + 1).astype(np.uint64) * _G))
    owner, share = doc[row], (weight[row] - low) / length                # accepted part of the block
    time = np.zeros(len(row), np.int64)
    drawn, batch = 0, 1
    while len(row):
        with np.errstate(over="ignore"):
            step = (np.arange(drawn, drawn + batch, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _G
            one = mix(seed[:, None] + step[None, :])
            two = mix(seed[:, None] + (step + _G)[None, :])
        gap = -np.log(((one >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        gap = np.rint(gap * (_TIME / length[:, None])).astype(np.int64)
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        place = (two >> np.uint64(32)).astype(np.float64) * 2.0 ** -32
        part = ((two & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        ok = place < share[:, None]
        np.minimum.at(sig, (owner[:, None] * m + part)[ok], at[ok])
        drawn, batch = drawn + batch, min(batch * 2, 32)
        time = at[:, -1]
        live = time < sig.reshape(n_docs, m).max(axis=1)[owner]
        seed, owner, share, length, time = seed[live], owner[live], share[live], length[live], time[live]
        row = row[live]
    return sig.reshape(n_docs, m)


def digest(w) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    h = hash_strings(w.vocab)[w.ids] if len(w.vocab) else np.zeros(0, np.uint64)
    place = (np.arange(len(h)) - np.repeat(w.offsets[:-1], w.counts)).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = []
        for salt in (np.uint64(11), np.uint64(29)):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h + mix(place * _G + salt)), out=total[1:])
            out.append(mix(total[w.offsets[1:]] - total[w.offsets[:-1]] + w.counts.astype(np.uint64) * salt))
    return out[0], out[1]


SIGNED = "hi long, node long, n long, bands array<long>, sig binary"


def signed(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, text (if asked, the row as ``doc`` instead) with content digest, shingle count, bands and
    short signature."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = docs.select(*cols)
    names = [c for c in rows.columns if c != "text" or not keep_row]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=2 << 20):
                w = words(text_column(piece))
                n = len(w.offsets) - 1
                hi, lo = digest(w)
                key, off = shingles(w)
                size = np.diff(off)
                sig = signatures(*bag(key, np.repeat(np.arange(n), size)), n)
                with np.errstate(over="ignore"):
                    band = np.zeros((n, BANDS), np.uint64)
                    for j in range(ROWS):
                        band = mix(band * _G + sig[:, j::ROWS].astype(np.uint64))
                    band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :])
                has = size > 0
                short = (mix(sig.astype(np.uint64)) >> np.uint64(48)).astype("<u2")
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)),
                    pa.array(band[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in names), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                     pa.array(size), bands, pa.array([s.tobytes() for s in short], pa.binary())],
                    [*names, "hi", "node", "n", "bands", "sig"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(sign, f"{schema}, {SIGNED}")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle multisets of two columns of texts."""
    n = len(a)
    bags, sizes = [], []
    for texts in (a, b):
        key, off = shingles(words(texts))
        size = np.diff(off)
        sizes.append(size)
        doc = np.repeat(np.arange(n), size)
        with np.errstate(over="ignore"):
            bags.append(bag(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))), doc))
    (da, ka, wa), (_, kb, wb) = bags
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(da[ia], weights=np.minimum(wa[ia], wb[ib]), minlength=n)
    return both / np.maximum(sizes[0] + sizes[1] - both, 1)


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: float, tasks: int = LEAST_TASKS) -> DataFrame:
    """Pairs whose sizes and short signatures allow the threshold."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    joined = (pairs.join(a, "a").coalesce(tasks).join(b, "b").coalesce(tasks)
              .filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(t.num_rows, COMPONENTS)
                        for c in ("sa", "sb"))
                keep = pa.array((x == y).sum(axis=1) >= LEAST_AGREEING)
                yield pa.RecordBatch.from_arrays([t.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return joined.mapInArrow(agree, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, tasks: int = LEAST_TASKS) -> DataFrame:
    """Pairs whose whole texts reach the threshold."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch, "tb", 2 << 20):
                keep = pa.array(overlap(text_column(t, "ta"), text_column(t, "tb")) >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([t.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return pairs.join(tb, "b").coalesce(tasks).join(ta, "a").coalesce(tasks).mapInArrow(check, "a long, b long")


def _spanning(rest: DataFrame) -> DataFrame:
    """Rows (bucket, node, root, ...) of buckets that hold several roots."""
    spread = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return stored(rest.join(spread.select("bucket"), "bucket"), "dup-open")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, size of each document); the k-th copy of a shingle is a token of its own."""
    key, off = shingles(words(texts))
    size = np.diff(off)
    doc, key, weight = bag(key, np.repeat(np.arange(len(size)), size))
    copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        token = mix(np.repeat(key, weight) + mix(copy.astype(np.uint64)) * _G)
    return np.repeat(doc, weight), token, size


def _prefix_pairs(rows: DataFrame, wanted: DataFrame, threshold: float, tasks: int = LEAST_TASKS) -> DataFrame:
    """(a, b): all pairs of (node, root) in ``wanted`` with different roots that may reach the threshold.

    Prefix filter: with tokens in one fixed order, texts that overlap enough
    share a token among their first ``n - ceil(threshold n) + 1``, and at the
    first shared one what remains of both bounds the overlap.  Any order is
    right; frequent tokens last makes it quick, as told by a bounded sample."""
    spark = rows.sparkSession
    texts = stored(_texts(rows, wanted.select("node"), tasks).join(wanted, "node").coalesce(tasks), "dup-rest")
    total = rows.join(wanted, "node", "left_semi").agg(F.sum("n")).first()[0] or 0
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE_TOKENS / max(total, 1))))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(_tokens(text_column(piece))[1].view(np.int64))], ["token"])

    seen = (texts.filter(draw).select("text").mapInArrow(listed, "token long").groupBy("token")
            .agg(F.count("*").alias("texts")).filter("texts > 1").toArrow())     # at most SAMPLE_TOKENS / 2 rows
    order = np.argsort(seen.column("token").to_numpy().view(np.uint64))
    common = spark.sparkContext.broadcast((seen.column("token").to_numpy().view(np.uint64)[order],
                                           seen.column("texts").to_numpy()[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for batch in batches:
            for piece in slices(batch, limit=2 << 20):
                doc, token, size = _tokens(text_column(piece))
                count = np.zeros(len(token), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    count = np.where(known[at] == token, often[at], 0)
                by = np.lexsort((token, count, doc))
                doc, token = doc[by], token[by]
                place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                keep = place <= size[doc] - np.ceil(threshold * size[doc] - 1e-9)
                doc, token, place = doc[keep], token[keep], place[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), piece.column("node").take(pa.array(doc)),
                     piece.column("root").take(pa.array(doc)), pa.array(size[doc] - place), pa.array(size[doc])],
                    ["token", "node", "root", "left", "n"])

    prefix = stored(texts.select("node", "root", "text").mapInArrow(
        prefixes, "token long, node long, root long, left long, n long"), "dup-prefix")
    # tokens of one root pair nothing
    spanning = prefix.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").coalesce(tasks)
    prefix = prefix.join(spanning.select("token"), "token").coalesce(tasks)
    a = prefix.select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("left").alias("la"),
                      F.col("n").alias("na")).alias("p")
    b = prefix.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("left").alias("lb"),
                      F.col("n").alias("nb")).alias("q")
    most = F.least("la", "lb")
    return a.join(b, (F.col("p.token") == F.col("q.token")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
                  & (most >= F.lit(threshold) * (F.col("na") + F.col("nb") - most))).select("a", "b").coalesce(tasks)


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of every node linked to another, from ``signed`` rows."""
    one = rows.filter("n > 0")
    total = rows.count()
    tasks = tasks_for(total)
    nodes = stored(one.select("hi", "node", "n", "bands", "sig").dropDuplicates(["hi", "node"]).coalesce(tasks), "dup-nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").coalesce(tasks)
    members = stored(members.join(shared, "bucket").coalesce(tasks), "dup-members")

    # who shares most buckets with most others stands nearest the middle of its group
    weight = members.groupBy("node").agg(F.sum("size").alias("weight")).coalesce(tasks)
    middle = (members.join(weight, "node").coalesce(tasks).groupBy("bucket")
              .agg(F.max(F.struct("weight", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot")).coalesce(tasks))
    members = stored(members.select("bucket", "node").join(middle, "bucket").coalesce(tasks), "dup-buckets")
    star = members.filter("node <> pivot")
    linked = _linked(one, nodes, star.select(F.col("pivot").alias("a"), F.col("node").alias("b")), threshold)
    roots = components(linked)

    # pivots are done with their buckets; the others go on where a bucket spans components
    rest = _spanning(star.select("bucket", "node").join(roots, "node", "left")
                     .select("bucket", "node", F.coalesce("root", "node").alias("root")).coalesce(tasks))
    wanted, open_ = counted(rest.select("node", "root").distinct().coalesce(tasks), "dup-wanted")
    if not open_:
        return roots
    more = _linked(one, None, _prefix_pairs(one, wanted, threshold, tasks), threshold)
    # what is linked already stands for the links it came from
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if more.take(1) else roots


def _linked(rows: DataFrame, nodes: DataFrame | None, pairs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs whose whole texts reach the threshold, written.

    With ``nodes``, pairs whose sizes or signatures speak against it are left
    unread; without, every pair's texts are read (exact pairs stay exact)."""
    tasks = tasks_for(rows.count())
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(tasks)
    likely = stored(pairs if nodes is None else _plausible(pairs, nodes, threshold, tasks), "dup-likely")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct().coalesce(tasks)
    return stored(_verified(likely, _texts(rows, wanted, tasks), threshold, tasks), "dup-links")


def _texts(rows: DataFrame, wanted: DataFrame, tasks: int = LEAST_TASKS) -> DataFrame:
    """One text of each wanted node (equal word sequences may differ in white space).

    Most texts are not wanted: those whose node falls in no cell of a wanted one
    stay where they are.  There are at most CELLS cells, which bounds the broadcast."""
    cell = F.pmod(F.col("node"), F.lit(CELLS))
    cells = F.broadcast(wanted.select(cell.alias("cell")).distinct().coalesce(tasks))
    near = rows.select("node", "text", cell.alias("cell")).join(cells, "cell", "left_semi")
    first = (near.join(wanted, "node", "left_semi")
             .groupBy("node").agg(F.min(F.struct(F.length("text"), F.col("text"))).alias("t")))
    return first.select("node", F.col("t.text").alias("text")).coalesce(tasks)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size and n_shingles of every document."""
    rows = stored(signed(docs), "dup-signed")
    found = _classed(rows.select("doc_id", "node", "n"), links(rows, threshold))
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("n").alias("n_shingles"))


def _classed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with class_id and class_size (null for rows without a word)."""
    rooted = (rows.join(roots, "node", "left")
              .withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node"))))
    per_class = (rooted.filter("root is not null").groupBy("root")
                 .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return rooted.join(per_class, "root", "left")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class (the least doc_id), all columns as they were.

    Rows with that doc_id in the class that are repeated, or without any id,
    are told apart by a number given once when the rows are written.
    """
    rows = stored(signed(docs, keep_row=True).withColumn("row", F.monotonically_increasing_id()), "dup-signed")
    plain = rows.select("hi", "node", "n", "bands", "sig", F.col("doc.text").cast("string").alias("text"))
    found = rows.select("doc_id", "node", "n", "row").join(links(plain, threshold), "node", "left")
    found = found.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    found = stored(found.filter("root is not null").select("root", "doc_id", "row"), "dup-roots")
    first = (found.groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least"))
             .select(F.col("least.row").alias("row")))
    copies = stored(found.select("row").join(first, "row", "left_anti"), "dup-copies")
    # rows in no cell of a copy stay where they are; the others meet the copies
    cell = F.pmod(F.xxhash64("row"), F.lit(CELLS))
    cells = F.broadcast(copies.select(cell.alias("cell")).distinct())
    marked = rows.select("doc", "row", cell.alias("cell"))
    sure = marked.join(cells, "cell", "left_anti").select("doc")
    rest = marked.join(cells, "cell", "left_semi").join(copies, "row", "left_anti").select("doc")
    return sure.union(rest).select("doc.*")
