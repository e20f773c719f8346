"""Source divergence audit by Gustavson row accumulation (operator 12).

Terms are runs of ASCII letters and non-ASCII characters, only A-Z
lower-cased.  Of each language the terms in at least ``LEAST_DOCS`` of its
documents are kept.  A group is a (lang, source); its smoothed share of a kept
term is ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, and p of an absent
term is the group's zero share.  The distance of two groups is the sum of
|p - q| over all kept terms, though only terms that occur are ever touched:

    D(g, h) = sum over g's terms of |p - zero(h)| + sum over h's of |q - zero(g)|
              + (V - terms of g - terms of h) |zero(g) - zero(h)|
              + sum over common terms of what these baselines got wrong

The last sum is Gustavson's row product: the term-major index holds each
term's groups; a group walks the runs of its own terms and scatters the
corrections into a dense accumulator with one cell per peer.  No pair of
postings is written anywhere.  The index is cut into blocks of terms and rows
of groups; blocks' accumulators are added by Spark.

All arithmetic is exact: p by decimals, sums in 64 bits (a group's shares
sum to about 10^9 + V).

Rows in, defined results: null text, lang and source are ''; a repeated row is
a document of its own; ties go to the item that is first in UTF-8 order; a
group without kept terms has zero shares; a language without kept terms has
distance 0 everywhere; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored
from cohorta.llm.tokens import Words, ragged, raw_bytes, slices, text_column, words

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Postings of a block of terms (the square of the language's sources if that is more, so that no more
#: cells leave the blocks than postings enter), and cells of the accumulators that one task fills.
BLOCK_POSTINGS = 50_000
BLOCK_CELLS = 1_000_000

#: Each byte as itself if it belongs to a term, A-Z lower-cased, else a space.
_TERM_BYTE = np.full(256, 0x20, np.uint8)
_TERM_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM_BYTE[0x80:] = np.arange(0x80, 0x100)


def terms(texts: pa.Array) -> Words:
    """Terms of each text (large_string without nulls)."""
    data, off = raw_bytes(texts)
    mapped = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(_TERM_BYTE[data]))
    return words(mapped)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed over a slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = terms(text_column(part))
                if not len(w.ids):
                    continue
                names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
                code = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
                group = code[0] * len(names[1].dictionary) + code[1]
                size = len(w.vocab)
                each, n = np.unique(w.owner() * size + w.ids, return_counts=True)
                key, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, n)
                g = key // size
                yield pa.RecordBatch.from_arrays(
                    [names[0].dictionary.take(pa.array(g // len(names[1].dictionary))).cast(pa.string()),
                     names[1].dictionary.take(pa.array(g % len(names[1].dictionary))).cast(pa.string()),
                     w.vocab.take(pa.array(key % size)).cast(pa.string()), pa.array(total),
                     pa.array(np.bincount(at, minlength=len(key)))],
                    ["lang", "source", "term", "n", "d"])

    return (docs.mapInArrow(count, "lang string, source string, term string, n long, d long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Term-major index of the kept terms: (lang, term, total, posts of (source, n)).

    A term has one posting per source of its language at most."""
    return (term_counts(docs).groupBy("lang", "term")
            .agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
            .filter(F.col("docs") >= least_docs).select("lang", "term", "total", "posts"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTHING) / (n + SMOOTHING v)), exactly; 0 if v is 0."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (n + v * SMOOTHING).cast("decimal(20,0)")
    floor = F.call_function("div", above, below)
    return F.when(v > 0, floor.cast("long") + 1).otherwise(F.lit(0).cast("long"))


def group_facts(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row per occurring group: code (from 0 in its language), sums of it and of its language, zero share,
    and into how many blocks of terms and rows the language is cut."""
    posts = index.select("lang", F.explode("posts").alias("post")).select("lang", "post.source", "post.n")
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    lang = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"),
                                     F.sum(F.size("posts")).alias("postings"))
    zero = F.lit(0).cast("long")
    # a language has as many rows here as each of its sources has peers in the result
    code = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    peers = F.count("*").over(Window.partitionBy("lang"))
    facts = (docs.groupBy("lang", "source").agg(F.lit(1))
             .join(own, ["lang", "source"], "left").join(lang, "lang", "left")
             .select("lang", "source", code.cast("long").alias("code"), peers.alias("peers"),
                     *(F.coalesce(c, zero).alias(c) for c in ("n", "n_terms", "v", "lang_n", "postings"))))
    return facts.select(
        "*", share(zero, F.col("n"), F.col("v")).alias("zero"),
        F.ceil(F.greatest(F.col("postings"), F.lit(1)) / F.greatest(F.lit(BLOCK_POSTINGS), F.col("peers") * F.col("peers")))
        .cast("int").alias("blocks"),
        F.ceil(F.col("peers") * F.col("peers") / F.lit(BLOCK_CELLS)).cast("int").alias("rows"))


def accumulate(posts: pa.Table, peers: pa.Table) -> pa.Table:
    """Distances that one block adds: (lang, g, h, value), some pairs more than once.

    ``posts`` are the postings of a block of terms, ``peers`` all groups of the language; only groups whose
    code falls to this row block walk the index."""
    if not peers.num_rows:
        return pa.table({"lang": [], "g": [], "h": [], "value": []}, schema=_CELLS)
    col = {c: peers.column(c).to_numpy() for c in ("code", "zero", "n_terms", "v", "block", "blocks", "row", "rows")}
    size = len(col["code"])
    zero, n_terms = np.empty(size, np.int64), np.empty(size, np.int64)
    zero[col["code"]], n_terms[col["code"]] = col["zero"], col["n_terms"]
    v, block, blocks, row, rows = (int(col[c][0]) for c in ("v", "block", "blocks", "row", "rows"))
    every = np.arange(size)

    term = posts.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    by_term = np.argsort(term, kind="stable")
    group, p = posts.column("code").to_numpy()[by_term], posts.column("p").to_numpy()[by_term]
    term = term[by_term]
    n_index = int(term[-1]) + 1 if len(term) else 0
    run = np.searchsorted(term, np.arange(n_index + 1))          # the run of each term in the index
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], np.arange(size + 1))

    g_out, h_out, value = [], [], []
    for g in range(row, size, rows):
        if g % blocks == block:                                   # terms that neither group has, once for all blocks
            g_out.append(np.full(size, g))
            h_out.append(every)
            value.append((v - n_terms[g] - n_terms) * np.abs(zero[g] - zero))
        own = by_group[first[g]:first[g + 1]]
        if not len(own):
            continue
        # own terms against each peer's zero share, from sorted shares and their sums
        sorted_p = np.sort(p[own])
        below = np.concatenate([[0], np.cumsum(sorted_p)])
        k = np.searchsorted(sorted_p, zero)
        alone = zero * k - below[k] + (below[-1] - below[k]) - zero * (len(own) - k)
        # common terms: walk their runs and scatter what the baselines got wrong
        sizes = run[term[own] + 1] - run[term[own]]
        at = ragged(run[term[own]], sizes)
        h, q, mine = group[at], p[at], np.repeat(p[own], sizes)
        cells = np.zeros(size, np.int64)
        np.add.at(cells, h, np.abs(mine - q) - np.abs(mine - zero[h]) - np.abs(zero[g] - q) + np.abs(zero[g] - zero[h]))
        g_out += [np.full(size, g), every]
        h_out += [every, np.full(size, g)]
        value += [cells + alone, alone]
    none = np.zeros(0, np.int64)
    g_all, h_all, value = (np.concatenate([none, *x]).astype(np.int64) for x in (g_out, h_out, value))
    return pa.table([pa.array([peers.column("lang")[0].as_py()] * len(g_all), pa.string()), pa.array(g_all),
                     pa.array(h_all), pa.array(value)], schema=_CELLS)


_CELLS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])


def pair_distances(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): distance of each group to each other source of its language."""
    cut = (posts.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
           .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
           .select("lang", "block", "row", "term", "code", "p"))
    # aliased: the postings hold columns of the same table
    fields = [F.col(c).alias(c) for c in ("lang", "code", "zero", "n_terms", "v", "blocks", "rows")]
    peers = (facts.select(*fields, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))))
    key = ["lang", "block", "row"]
    cells = (cut.groupBy(*key).cogroup(peers.groupBy(*key))
             .applyInArrow(accumulate, "lang string, g long, h long, value long"))
    total = cells.filter("g <> h").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    def named(code: str, name: str) -> DataFrame:
        return facts.select(F.col("lang").alias("lang"), F.col("code").alias(code), F.col("source").alias(name))

    return (total.join(named("g", "source"), ["lang", "g"]).join(named("h", "item"), ["lang", "h"])
            .select("lang", "source", "item", "value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: parts ``pair`` (all peers) and ``term`` (the first ``top_terms``)."""
    rows = plain(docs)
    index = stored(term_index(rows, least_docs), "divergence-index")
    facts = stored(group_facts(rows, index), "divergence-groups")
    posts = (index.select("lang", "term", "total", F.explode("posts").alias("post"))
             .select("lang", "term", "total", "post.source", F.col("post.n").alias("count"))
             .join(facts, ["lang", "source"])
             .withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))))
    pair = pair_distances(posts, facts).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = F.col("p") - share(F.col("total"), F.col("lang_n"), F.col("v"))
    over = posts.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pair.withColumn("rank", F.row_number().over(best)).select(*columns)
            .union(over.filter("value > 0").withColumn("rank", F.row_number().over(best))
                   .filter(F.col("rank") <= top_terms).select(*columns)))


def divergence_sql() -> str:
    """The contract in DuckDB SQL, pair by pair."""
    return """
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  coalesce(text, '') as text from documents),
t as (select k, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from t group by lang, term having count(distinct k) >= 30),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by lang, source, term),
gn as (select lang, source, sum(n)::hugeint as total from c group by lang, source),
ln as (select lang, sum(n)::hugeint as total from c group by lang),
gp as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
              1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v.v) as p
       from g join kept using (lang) join v using (lang)
       left join gn on gn.lang = g.lang and gn.source = g.source
       left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
lp as (select lang, term, 1 + (1000000000::hugeint * (sum(n)::hugeint + 5)) // (any_value(ln.total) + 5 * any_value(v.v)) as q
       from c join ln using (lang) join v using (lang) group by lang, term),
far as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p))::bigint as value
        from gp x join gp y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(far.value, 0) as value
         from g a join g b on a.lang = b.lang and a.source <> b.source
         left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
term as (select gp.lang, gp.source, 'term' as part, gp.term as item, (gp.p - lp.q)::bigint as value
         from gp join lp using (lang, term) where gp.n > 0 and gp.p > lp.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
           from (select * from pair union all select * from term))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50"""
