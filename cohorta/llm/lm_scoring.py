"""N-gram language model as a weighted backoff automaton (operator 7).

Words are lower-cased (A-Z) and each document ends with an end token.  States
are contexts seen in training; an arc spells a word and adds the log
probability of the n-gram; the failure arc of a state leads to its longest
proper suffix and adds the log of the mass left to it.  Smoothing is a chain
of Dirichlet priors: p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu), the last
level being (c + 0.5) / (N + 0.5 (V + 1)).

Corpus counts never meet in one place.  Texts become chunks of word numbers
(one bucketed table).  For each order every chunk sends its n-grams, counted,
to the bucket of their hash; the bucket answers with the corpus counts.  A
chunk asks only for n-grams whose context and suffix both occur in another
chunk too: the others are its own, and so are their counts.  The answers of a chunk
are its part of the automaton, and each text is traversed once over it, left
to right, many texts side by side.

Rows in, defined results: a null text is empty (one end token); a null doc_id
is learned from and not held out; repeated rows are documents of their own;
with no training document every score is 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import shared_folder, stored
from cohorta.llm.tokens import hash_strings, mix, per_doc, slices, text_column, words

CHUNK_BYTES = 8 << 20
BUCKET_TOKENS = 2_500_000
#: A count from here on is this mark in the 31 bits of an answer, and whole in the list beside it.
LARGE = 2**31 - 1
ORDER = 3
MU = 400.0
SEGMENT = 256
_END = np.uint64(0x5D3C1A9E77B24F01)
_BEGIN = np.uint64(0x1F83D9ABFB41BD6B)


def held_out() -> Column:
    """crc32 of the id as text leaves 1 modulo 5 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


CHUNK_SCHEMA = ("chunk long, doc_ids array<long>, held array<boolean>, sizes array<long>, "
                "tokens binary, hashes binary, n_tokens long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in slices(batch, limit=CHUNK_BYTES):
            w = words(pc.ascii_lower(text_column(piece)))
            vocab = np.append(hash_strings(w.vocab), _END)
            n = len(w.offsets) - 1
            ids = np.insert(w.ids, w.offsets[1:], len(vocab) - 1)
            # frequent words first: small numbers compress well
            used = np.bincount(ids, minlength=len(vocab))
            order = np.argsort(-used, kind="stable")
            rank = np.empty(len(vocab), np.int64)
            rank[order] = np.arange(len(vocab))
            present = int((used > 0).sum())

            def one(values, kind):
                return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values.cast(kind))

            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + k]), one(piece.column("doc_id"), pa.int64()),
                 one(piece.column("held"), pa.bool_()), one(pa.array(w.counts + 1), pa.int64()),
                 pa.array([rank[ids].astype("<u4").tobytes()], pa.binary()),
                 pa.array([vocab[order][:present].tobytes()], pa.binary()), pa.array([len(ids)])],
                ["chunk", "doc_ids", "held", "sizes", "tokens", "hashes", "n_tokens"])
            k += 1


class Level:
    """Distinct n-grams of one order in a chunk.  Numbers of n-grams and words take 32 bits: a chunk has fewer tokens."""

    def __init__(self, count: np.ndarray, hashes: np.ndarray, context: np.ndarray, suffix: np.ndarray,
                 word: np.ndarray) -> None:
        self.count, self.hashes = count, hashes          # local training count, identity
        self.context, self.suffix, self.word = context, suffix, word
        self.total = count                               # corpus count once known
        self.shared = np.zeros(len(count), bool)         # found in another chunk too

    def settle(self) -> None:
        """Let go of what only the next order and the buckets need."""
        self.count = self.hashes = None


class Chunk:
    """Token runs of a chunk with its n-grams, level by level (level 1 ends with the begin mark)."""

    def __init__(self, row: dict) -> None:
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.held = np.asarray(row["held"], bool)
        tokens = np.frombuffer(row["tokens"], "<i4")
        self.hash1 = np.append(np.frombuffer(row["hashes"], np.uint64), _BEGIN)
        self.width = len(self.hash1)
        n = len(self.sizes)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        first = np.cumsum(self.sizes) - self.sizes
        self.run = np.insert(tokens, first, self.width - 1)   # begin mark before each document
        self.place = np.arange(len(self.run), dtype=np.int32)
        self.place -= np.repeat(self.offsets[:-1].astype(np.int32), self.sizes + 1)
        self.train = np.repeat(~self.held, self.sizes + 1)
        count = np.bincount(self.run[self.train], minlength=self.width)
        none = np.zeros(0, np.int32)
        self.levels = [Level(count, self.hash1, none, none, np.arange(self.width, dtype=np.int32))]
        self.at = self.run                                     # n-gram of the last level ending at each place

    def grow(self) -> Level:
        """Add the next order."""
        k = len(self.levels)
        below = self.levels[-1]
        here = np.flatnonzero(self.place >= k)
        key = self.at[here - 1].astype(np.int64)
        key *= self.width
        key += self.run[here]
        order = np.argsort(key)
        key = key[order]
        edge = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=edge[1:])
        unique = key[edge]
        del key
        ident = np.cumsum(edge, dtype=np.int32)
        ident -= 1
        inverse = np.empty(len(order), np.int32)
        inverse[order] = ident
        suffix = self.at[here[order[edge]]]
        del ident, order, edge
        context, word = (unique // self.width).astype(np.int32), (unique % self.width).astype(np.int32)
        del unique
        with np.errstate(over="ignore"):
            h = below.hashes[context]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += self.hash1[word]
            h += np.uint64(k)
        h = mix(h)
        level = Level(np.bincount(inverse[self.train[here]], minlength=len(h)), h, context, suffix, word)
        self.at = np.full(len(self.run), -1, np.int32)
        self.at[here] = inverse
        self.levels.append(level)
        below.settle()                                         # its answer is here
        return level

    def asks(self, level: Level) -> np.ndarray:
        """Which n-grams may occur in another chunk too (in training or held-out texts), by hash above the words."""
        if level is self.levels[0]:
            return np.arange(len(level.hashes))
        below = self.levels[self.levels.index(level) - 1]
        ask = np.flatnonzero(below.shared[level.context] & below.shared[level.suffix])
        return ask[np.argsort(level.hashes[ask], kind="stable")]

    def answer(self, level: Level, replies: list[dict], buckets: int) -> None:
        """Set corpus counts from the replies of the buckets."""
        asked = self.asks(level)
        bucket = (level.hashes[asked] % np.uint64(buckets)).astype(np.int32)
        asked = asked[np.argsort(bucket, kind="stable")]
        del bucket
        replies = [(np.frombuffer(r["counts"], "<u4"), r["large"]) for r in sorted(replies, key=lambda r: r["bucket"])]
        if sum(len(got) for got, _ in replies) != len(asked):
            raise ValueError("a bucket's answer is missing")
        level.total = level.count.astype(np.int64)
        at = 0
        for got, large in replies:
            total = (got >> 1).astype(np.int64)
            total[total == LARGE] = np.frombuffer(large, "<i8")
            some = asked[at:at + len(got)]
            level.total[some] = total
            level.shared[some] = got & 1
            at += len(got)


def _known(row: dict, upto: int, buckets: int) -> Chunk:
    """The chunk with corpus counts of the orders up to ``upto``."""
    c = Chunk(row)
    for k in range(1, upto + 1):
        level = c.levels[0] if k == 1 else c.grow()
        c.answer(level, [{**r, "counts": expanded(r["counts"], "<u4")} for r in row["replies"] or [] if r["order"] == k],
                 buckets)
    return c


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: (b.column(name)[i].values.to_numpy(zero_copy_only=False)
                          if name in ("held", "sizes") else b.column(name)[i].as_py())
                   for name in b.schema.names if name != "doc_ids"} | {
                       "doc_ids": b.column("doc_ids")[i].values if "doc_ids" in b.schema.names else None}


def squeezed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed; as they are where that is shorter."""
    raw = values.tobytes()
    planes = np.frombuffer(raw, np.uint8).reshape(-1, values.itemsize).T.tobytes()
    small = pa.Codec("zstd").compress(planes, asbytes=True)
    if len(small) + 8 >= len(raw):
        return b"\0" + raw
    return b"\1" + len(raw).to_bytes(8, "little") + small


def expanded(blob: bytes, kind: str) -> np.ndarray:
    if blob[:1] == b"\0":
        return np.frombuffer(blob, kind, offset=1)
    planes = pa.Codec("zstd").decompress(blob[9:], int.from_bytes(blob[1:9], "little"), asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_hashes(h: np.ndarray, buckets: int) -> bytes:
    """Hashes of one bucket: the bucket tells their remainder, and sorted ones lie close together."""
    q = h // np.uint64(buckets)
    return squeezed(np.diff(q, prepend=np.uint64(0)).astype("<u8"))


def unpack_hashes(blob: bytes, bucket: int, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        q = np.cumsum(expanded(blob, "<u8"), dtype=np.uint64)
        return q * np.uint64(buckets) + np.uint64(bucket)


GRAMS = "bucket long, chunk long, hashes binary, counts binary"
REPLIES = "chunk long, bucket long, counts binary, large binary, n_distinct long, n_total long"


def _sender(order: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _known(row, order - 1, buckets)
            level = c.levels[0] if order == 1 else c.grow()
            ask = c.asks(level)
            bucket = (level.hashes[ask] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            ask = ask[by]
            h, n = level.hashes[ask], level.count[ask].astype("<u4")
            del c, level, ask, bucket, by      # only what is sent stays while it is taken
            used = np.flatnonzero(np.diff(edge))
            for k in range(0, len(used), 256):
                some = used[k:k + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), row["chunk"])),
                     pa.array([pack_hashes(h[edge[b]:edge[b + 1]], buckets) for b in some], pa.binary()),
                     pa.array([squeezed(n[edge[b]:edge[b + 1]]) for b in some], pa.binary())],
                    ["bucket", "chunk", "hashes", "counts"])
            del row, h, n                      # before the next chunk is built
    return send


def _merge(table: pa.Table, hashes=lambda blob, bucket: np.frombuffer(blob, np.uint64),
           counts=lambda blob: np.frombuffer(blob, "<u4"), pack=np.ndarray.tobytes) -> pa.Table:
    """Corpus counts of one bucket's n-grams, handed back to the chunks that asked."""
    parts = [hashes(h.as_py(), b.as_py()) for h, b in zip(table.column("hashes"), table.column("bucket"))]
    sizes = np.array([len(h) for h in parts], np.int64)
    h = np.concatenate(parts)
    del parts
    order = np.argsort(h)
    h = h[order]
    edge = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=edge[1:])
    first = np.flatnonzero(edge)
    own = h[first] != _BEGIN                      # the begin mark is no token
    del h
    n = np.concatenate([counts(n.as_py()) for n in table.column("counts")])
    total = np.add.reduceat(n[order], first, dtype=np.int64)
    del n
    # a chunk sends an n-gram once, so several senders mean that several chunks have it
    several = np.diff(np.append(first, len(edge))) > 1
    gram = np.cumsum(edge, dtype=np.int32)
    gram -= 1
    back = np.empty(len(order), "<u4")
    back[order] = (np.minimum(total, LARGE) << 1 | several).astype("<u4")[gram]
    over = np.flatnonzero((total >= LARGE)[gram])
    over = over[np.argsort(order[over])]
    ends = np.cumsum(sizes)
    whole, cut = total[gram[over]].astype("<i8"), np.searchsorted(order[over], np.append(0, ends))
    del gram, order
    rows = len(sizes)
    distinct, tokens = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    distinct[0], tokens[0] = int((total[own] > 0).sum()), int(total[own].sum())
    return pa.table([table.column("chunk"), table.column("bucket"),
                     pa.array([pack(back[e - k:e]) for e, k in zip(ends, sizes)], pa.binary()),
                     pa.array([whole[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array(distinct), pa.array(tokens)],
                    names=["chunk", "bucket", "counts", "large", "n_distinct", "n_total"])


def _merger(buckets: int):
    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, lambda blob, bucket: unpack_hashes(blob, bucket, buckets),
                      lambda blob: expanded(blob, "<u4"), squeezed)
    return merge


class Arcs:
    """Lookup of arcs by (state, word): a directory over sorted scrambled keys; ``order`` is theirs."""

    def __init__(self, key: np.ndarray) -> None:
        scrambled = mix(key.astype(np.uint64, copy=False))
        self.order = np.argsort(scrambled)
        self.keys = np.append(scrambled[self.order], np.uint64(2**64 - 1))
        del scrambled
        bits = max(1, len(key).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted ones or -1."""
        q = mix(key.astype(np.uint64))
        at = self.first[(q >> self.shift).astype(np.int64)]
        live = np.flatnonzero(self.keys[at] < q)
        while len(live):
            at[live] += 1
            live = live[self.keys[at[live]] < q[live]]
        return np.where((self.keys[at] == q) & (at < len(self.keys) - 1), at, -1)


class Automaton:
    """States, arcs and failure arcs of the n-grams of a chunk, whose orders above the first it uses up.

    State 0 is the root; the states of context length k follow those of k - 1.
    The root has an arc for every word.
    """

    def __init__(self, c: Chunk, n_train: int, n_distinct: int, mu: float) -> None:
        self.root = np.log10((c.levels[0].total + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
        self.top = len(c.levels)
        self.width = c.width
        arcs = sum(np.count_nonzero(level.total > 0) for level in c.levels[1:])
        key, self.weight, self.target = np.empty(arcs, np.int64), np.empty(arcs), np.empty(arcs, np.int32)
        self.fail, self.back = [np.zeros(1, np.int32)], [np.zeros(1)]
        prob, base, put = 10.0 ** self.root, 1, 0
        below = below_ids = None
        self.start = np.zeros(self.width, np.int32)         # where the root's arcs lead
        for k in range(1, self.top + 1):
            level = c.levels[k - 1]
            seen = np.flatnonzero(level.total > 0)
            ids = None
            if k < self.top:
                ids = np.full(len(level.total), -1, np.int32)
                ids[seen] = np.arange(base, base + len(seen), dtype=np.int32)
                base += len(seen)
                # a context with a suffix that was seen; every seen one's is
                self.fail.append(np.zeros(len(seen), np.int32) if k == 1 else below_ids[level.suffix[seen]])
                self.back.append(np.log10(mu / (level.total[seen] + mu)))
                if k == 1:
                    self.start = np.maximum(ids, 0)
            if k > 1:
                some = slice(put, put + len(seen))
                put += len(seen)
                context, suffix = level.context[seen], level.suffix[seen]
                key[some] = below_ids[context]
                key[some] *= self.width
                key[some] += level.word[seen]
                self.target[some] = ids[seen] if k < self.top else below_ids[suffix]
                p = (level.total[seen] + mu * prob[suffix]) / (below.total[context] + mu)
                del context, suffix
                self.weight[some] = np.log10(p)
                if k < self.top:
                    prob = np.zeros(len(level.total))
                    prob[seen] = p
                del p
            below, below_ids = level, ids
            if k > 2:
                c.levels[k - 2] = None
        del prob, seen, below, below_ids, ids, level
        del c.levels[1:]
        self.fail, self.back = np.concatenate(self.fail), np.concatenate(self.back)
        self.arcs = Arcs(key)
        del key
        self.weight, self.target = self.weight[self.arcs.order], self.target[self.arcs.order]
        self.arcs.order = None                              # weights and targets lie in it now

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word from each state: (next states, log10 probabilities)."""
        gain = np.zeros(len(state))
        after = np.zeros(len(state), np.int32)
        live = np.arange(len(state))
        s = state.copy()
        while len(live):
            root = live[s[live] == 0]
            gain[root] += self.root[word[root]]
            after[root] = self.start[word[root]]
            live = live[s[live] != 0]
            arc = self.arcs.find(s[live].astype(np.int64) * self.width + word[live])
            hit = arc >= 0
            gain[live[hit]] += self.weight[arc[hit]]
            after[live[hit]] = self.target[arc[hit]]
            live = live[~hit]
            gain[live] += self.back[s[live]]
            s[live] = self.fail[s[live]]
        return after, gain


def traverse(a: Automaton, run: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each run (its first token, the begin mark, is not scored).

    Long runs are read as segments side by side; a segment first reads the
    ``order - 1`` tokens before it, which fix the state it starts in.
    """
    warm = a.top - 1
    sizes = np.diff(offsets) - 1
    per = -(-sizes // segment)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = offsets[doc] + 1 + nth * segment
    length = np.minimum(sizes[doc] - nth * segment, segment)
    order = np.argsort(-length, kind="stable")
    doc, first, length = doc[order], first[order], length[order]
    state = np.zeros(len(doc), np.int32)
    for j in range(-warm, 0):
        ok = np.flatnonzero(first + j >= offsets[doc])
        state[ok] = a.step(state[ok], run[first[ok] + j])[0]
    out = np.zeros(len(sizes))
    total = np.zeros(len(doc))
    for j in range(int(length.max()) if len(length) else 0):
        n = int(np.searchsorted(-length, -j, side="left"))     # runs longer than j
        state[:n], gain = a.step(state[:n], run[first[:n] + j])
        total[:n] += gain
    np.add.at(out, doc, total)
    return out


def _scorer(order: int, buckets: int, n_train: int, n_distinct: int, mu: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _known(row, order, buckets)
            doc_ids = row["doc_ids"]
            del row
            c.levels[-1].settle()
            known = c.levels[0].total > 0
            c.at = c.train = None
            a = Automaton(c, n_train, n_distinct, mu)
            inside = c.place > 0
            c.place = None
            base = per_doc(np.where(inside, a.root[c.run], 0.0), c.offsets)
            known = per_doc(inside & known[c.run], c.offsets)
            del inside
            out = pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(c.held), pa.array(c.sizes), pa.array(known),
                 pa.array(np.full(len(c.sizes), n_train)), pa.array(base),
                 pa.array(traverse(a, c.run, c.offsets))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del c, a                           # before the next chunk is built
            yield out
    return score


def score_corpus(docs: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"),
                       F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = f"lm_chunks_{uuid.uuid4().hex}"
    # buckets by chunk: the joins below move the answers, never the chunks.  With fewer
    # buckets than shuffle partitions Spark would deal out both sides anew
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.mapInArrow(_chunks, CHUNK_SCHEMA).write
     .bucketBy(int(min(50_000, max(least, n_bytes // (2 * CHUNK_BYTES)))), "chunk")
     .option("path", shared_folder(spark, "lm-chunks")).option("compression", "zstd").saveAsTable(table))
    try:
        chunks = spark.table(table)
        n_tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
        buckets = max(4, math.ceil(n_tokens / BUCKET_TOKENS))
        answers: DataFrame | None = None
        n_train = n_distinct = 0
        for k in range(1, order + 1):
            asked = _with_replies(chunks, answers).mapInArrow(_sender(k, buckets), GRAMS)
            got = stored(asked.groupBy("bucket").applyInArrow(_merger(buckets), REPLIES)
                         .withColumn("order", F.lit(k)), f"lm-counts-{k}")
            if k == 1:
                total = got.agg(F.sum("n_total"), F.sum("n_distinct")).first()
                n_train, n_distinct = int(total[0] or 0), int(total[1] or 0)
            got = got.select("chunk", "order", "bucket", "counts", "large")
            answers = got if answers is None else answers.unionByName(got)

        return stored(_with_replies(chunks, answers).mapInArrow(
            _scorer(order, buckets, n_train, n_distinct, mu),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double"), "lm-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _with_replies(chunks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Each chunk with its answers so far (left join on the bucketed chunk number)."""
    if answers is None:
        return chunks.withColumn("replies", F.lit(None).cast("array<struct<order:int,bucket:long,counts:binary,large:binary>>"))
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "counts", "large")).alias("replies"))
    return chunks.join(own.hint("shuffle_merge"), "chunk", "left")
