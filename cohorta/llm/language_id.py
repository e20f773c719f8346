"""Language identification by segmentation-marginalised unigrams (operator 2).

A fixed public piece vocabulary gives every language a distribution over
pieces.  The probability of a word is the sum over all its segmentations into
pieces, by a forward pass over its characters; a text's is the product over
its words.  Piece probabilities are learned by expectation maximisation
(forward-backward expected counts) on word counts of labelled documents.

Words are runs between white space, lower-cased, letters only, with a word
start mark.  All pieces of the vocabulary with a letter count, whatever their
length.  Long words (whole sentences in scripts without spaces) are scored
block by block: the last nodes of a block's lattice are carried into the next
one and rescaled, so the sum runs over all segmentations of the whole word
and does not vanish.  For learning, words beyond ``LEARN_LETTERS`` letters are
cut there.  Every labelled language is learned.

Rows in, defined results: a null text or one without a letter is ``und`` with
score 0; ties go to the first language by name; rows with a null lang or
doc_id are scored but not learned from; repeated rows get equal results; with
nothing to learn from everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored
from cohorta.llm.tokens import mix, ragged, slices, text_column, words

START = "▁"
#: Letters after which a word is cut for learning; scoring never cuts one.
LEARN_LETTERS = 4096
#: Decimal digits that a block of a lattice may lose before it is rescaled (doubles have 308).
BLOCK_DIGITS = 180
#: Learning bound: about this many characters of each language, drawn by a hash
#: of doc_id.
TRAIN_CHARS = 3_000_000
#: Languages learned and scored at once (memory, not a bound on languages).
LANG_GROUP = 32
ROUNDS = 3
#: Added to every expected count, so that no piece is impossible.
DELTA = 0.01
UNDETERMINED = "und"


class Lattice(NamedTuple):
    """Pieces found in words; word w spans the nodes ``first[w] .. first[w]+size[w]``."""

    first: np.ndarray
    size: np.ndarray
    start: np.ndarray    # node where an arc starts, sorted by end position in the word
    end: np.ndarray
    piece: np.ndarray
    level: np.ndarray    # first arc of each end position


class Vocabulary:
    """Pieces of a public model by rolling hash of their code points; the last id is 'other letter'."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.pieces = sorted({p for p in found if p == START or any(c.isalpha() for c in p)})
        self.longest = max(map(len, self.pieces))
        self.other = len(self.pieces)
        points, off = code_points(pa.array(self.pieces, pa.large_string()))
        size = np.diff(off)
        key = np.zeros(len(size), np.uint64)
        for j in range(self.longest):
            on = size > j
            key[on] = step(key[on], points[off[:-1][on] + j])
        order = np.argsort(key)
        self.keys, self.ids = key[order], order
        self.small = np.zeros(1 << 20, bool)
        self.small[self.keys >> np.uint64(44)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece id of each hash or -1."""
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.small[key >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def lattice(self, values: pa.Array) -> Lattice:
        """All pieces at all places of the words."""
        points, off = code_points(values)
        size = np.diff(off)
        first = off[:-1] + np.arange(len(size))          # one more node than characters
        word = np.repeat(np.arange(len(size)), size)
        left = np.repeat(off[1:], size) - np.arange(len(points))
        node = np.arange(len(points)) + word
        place = np.arange(len(points)) - np.repeat(off[:-1], size)
        key = np.zeros(len(points), np.uint64)
        starts, ends, pieces, places = [], [], [], []
        at = np.arange(len(points))
        for j in range(self.longest):
            at = at[left[at] > j]
            if not len(at):
                break
            key[at] = step(key[at], points[at + j])
            p = self.find(key[at])
            if j == 0:
                p = np.where(p < 0, self.other, p)
            hit = p >= 0
            a = at[hit]
            starts.append(node[a])
            ends.append(node[a] + j + 1)
            pieces.append(p[hit])
            places.append(place[a] + j)
        if not starts:
            none = np.zeros(0, np.int64)
            return Lattice(first, size, none, none, none, np.zeros(1, np.int64))
        start, end, piece, where = (np.concatenate(x) for x in (starts, ends, pieces, places))
        order = np.lexsort((end, where))
        level = np.searchsorted(where[order], np.arange(int(where.max()) + 2))
        return Lattice(first, size, start[order], end[order], piece[order], level)


def code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(values.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.concatenate([[0], np.cumsum(size)])


def step(key: np.ndarray, point: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0x100000001B3) + point + np.uint64(1))


_VOCABS: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABS:
        _VOCABS[path] = Vocabulary(path)
    return _VOCABS[path]


def _add(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """target[at] += values for ``at`` sorted."""
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    target[at[edge]] += np.add.reduceat(values, edge, axis=0)


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """Probability mass that reaches each node, for each language (nodes x languages)."""
    alpha = np.zeros((int(lat.size.sum()) + len(lat.size), prob.shape[1]))
    alpha[lat.first] = 1.0
    for a, b in zip(lat.level, lat.level[1:]):
        if b > a:
            _add(alpha, lat.end[a:b], alpha[lat.start[a:b]] * prob[lat.piece[a:b]])
    return alpha


def expected(lat: Lattice, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of one language that occur ``count`` times (forward-backward, by logarithms)."""
    gain = np.log(prob)[lat.piece]
    alpha = np.full(int(lat.size.sum()) + len(lat.size), -np.inf)
    beta = alpha.copy()
    last = lat.first + lat.size
    alpha[lat.first], beta[last] = 0.0, 0.0
    for a, b in zip(lat.level, lat.level[1:]):           # arcs by their end: a node's come together
        if b > a:
            _log_sum(alpha, lat.end[a:b], alpha[lat.start[a:b]] + gain[a:b])
    word = np.searchsorted(lat.first, lat.start, side="right") - 1
    place = lat.start - lat.first[word]
    order = np.lexsort((lat.start, -place))              # and backwards by their start
    edge = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edge, edge[1:]):
        own = order[a:b]
        _log_sum(beta, lat.start[own], gain[own] + beta[lat.end[own]])
    mass = np.exp(alpha[lat.start] + gain + beta[lat.end] - alpha[last][word]) * count[word]
    return np.bincount(lat.piece, weights=mass, minlength=len(prob))


def _log_sum(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """target[at] = log of the sum of exp(values) for ``at`` sorted."""
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    most = np.maximum.reduceat(values, edge)
    size = np.diff(np.append(edge, len(at)))
    target[at[edge]] = most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, size)), edge))


def clean(vocab: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words lower-cased to letters only, map from vocab to them)."""
    bare = pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}]+", "")
    coded = bare.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def stretches(values: pa.Array, letters: int = LEARN_LETTERS) -> tuple[pa.Array, np.ndarray]:
    """(marked words, cut after so many letters, word of each)."""
    values = values.cast(pa.large_string())
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
    short = np.flatnonzero((size > 0) & (size <= letters))
    marked = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), values.take(pa.array(short)),
                                         pa.scalar("", pa.large_string()))
    cut, of = [], []
    for i in np.flatnonzero(size > letters).tolist():
        text = values[i].as_py()
        cut.extend((START if j == 0 else "") + text[j:j + letters] for j in range(0, len(text), letters))
        of.append(np.full(-(-len(text) // letters), i))
    return pa.concat_arrays([marked, pa.array(cut, pa.large_string())]), np.concatenate([short, *of])


def block_letters(prob: np.ndarray) -> int:
    """Letters of a block: even if each is the least likely piece, its probability stays a double."""
    return max(4, int(BLOCK_DIGITS / -np.log10(min(prob.min(), 0.1))))


def word_scores(values: pa.Array, vocab: Vocabulary, prob: np.ndarray, group: int = 40_000) -> np.ndarray:
    """log P of each cleaned word for each language; empty words score 0."""
    out = np.zeros((len(values), prob.shape[1]))
    values = values.cast(pa.large_string())
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
    block = block_letters(prob)
    short = np.flatnonzero((size > 0) & (size < block))
    for k in range(0, len(short), group):
        at = short[k:k + group]
        marked = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()),
                                             values.take(pa.array(at)), pa.scalar("", pa.large_string()))
        lat = vocab.lattice(marked)
        out[at] = np.log(forward(lat, prob)[lat.first + lat.size])
    long = np.flatnonzero(size >= block)
    # so many words side by side that a block of them is no larger than a group of short ones
    for k in range(0, len(long), max(1, group // 8)):
        at = long[k:k + max(1, group // 8)]
        out[at] = long_scores([START + values[int(i)].as_py() for i in at], vocab, prob, block)
    return out


def long_scores(marked: list[str], vocab: Vocabulary, prob: np.ndarray, block: int) -> np.ndarray:
    """log P of words of any length: blocks of their lattices, each going on from the last nodes of the one before."""
    total = np.zeros((len(marked), prob.shape[1]))
    keep = vocab.longest                       # a piece that ends in a block starts at one of so many nodes before it
    carry = np.zeros((len(marked), keep, prob.shape[1]))
    carry[:, -1] = 1.0                         # nodes before the word hold nothing, its first node all
    live, at = np.arange(len(marked)), 0
    while len(live):
        before = min(at, keep - 1)
        parts = [marked[i][at - before:at + block] for i in live]
        lat = vocab.lattice(pa.array(parts, pa.large_string()))
        alpha = np.zeros((int(lat.size.sum()) + len(lat.size), prob.shape[1]))
        for j in range(before + 1):
            alpha[lat.first + j] = carry[live, keep - 1 - before + j]
        # pieces that end among the carried nodes are summed already
        for a, b in zip(lat.level[before:], lat.level[before + 1:]):
            if b > a:
                _add(alpha, lat.end[a:b], alpha[lat.start[a:b]] * prob[lat.piece[a:b]])
        last = lat.first + lat.size
        done = np.array([at + block >= len(marked[i]) for i in live])
        total[live[done]] += np.log(alpha[last[done]])
        live, last, first = live[~done], last[~done], lat.first[~done]
        at += block
        for j in range(keep):
            node = last - (keep - 1 - j)
            carry[live, j] = np.where((node >= first)[:, None], alpha[np.maximum(node, 0)], 0.0)
        scale = carry[live].max(axis=1)
        total[live] += np.log(scale)
        carry[live] /= scale[:, None]
    return total


def held_out() -> Column:
    """crc32 of the id as text leaves 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, vocab_path: str, train_chars: int = TRAIN_CHARS,
          rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities: pieces x languages) from text and lang of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")).filter("lang is not null and doc_id is not null")
    # one row per language; the model's matrix has a column for each
    chars = stored(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).filter("chars > 0"), "language-chars")
    langs = sorted(r.lang for r in chars.select("lang").collect())
    vocab = vocabulary(vocab_path)
    if not langs:
        return [], np.zeros((vocab.other + 1, 0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = (rows.join(F.broadcast(chars), "lang").filter(draw < train_chars / F.col("chars"))
              .select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                w = words(text_column(piece))
                values, code = clean(w.vocab)
                lang = piece.column("lang").dictionary_encode()
                of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.owner()]
                word, n = np.unique(of * max(len(values), 1) + code[w.ids], return_counts=True)
                cut, owner = stretches(values)
                order = np.argsort(owner, kind="stable")
                first = np.searchsorted(owner[order], np.arange(len(values) + 1))
                own = word % max(len(values), 1)
                size = first[own + 1] - first[own]
                at = order[ragged(first[own], size)]
                # a bounded number of rows at once
                of, n = np.repeat(word // max(len(values), 1), size), np.repeat(n, size)
                for k in range(0, len(at), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [lang.dictionary.cast(pa.string()).take(pa.array(of[some])),
                         cut.take(pa.array(at[some])).cast(pa.string()), pa.array(n[some])], ["lang", "word", "n"])

    table = stored(sample.mapInArrow(count, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    groups = [langs[k:k + LANG_GROUP] for k in range(0, len(langs), LANG_GROUP)]
    out = np.empty((vocab.other + 1, len(langs)))
    for g, names in enumerate(groups):
        own = table if len(groups) == 1 else table.filter(F.col("lang").between(names[0], names[-1]))
        out[:, g * LANG_GROUP:g * LANG_GROUP + len(names)] = _maximise(own, names, vocab_path, rounds)
    return langs, out


def _maximise(table: DataFrame, langs: list[str], vocab_path: str, rounds: int) -> np.ndarray:
    """Piece probabilities of some languages from (lang, word: marked stretch, n), by EM."""
    size = vocabulary(vocab_path).other + 1
    prob = np.full((size, len(langs)), 1.0 / size)
    column = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(prob)      # pieces x languages: bounded by both

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, p = vocabulary(vocab_path), shared.value
            total = np.zeros(p.shape)
            for b in batches:
                of = np.array([column[x] for x in b.column("lang").to_pylist()], np.int64)
                n = b.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
                marked = b.column("word").cast(pa.large_string())
                for k in np.unique(of):
                    own = np.flatnonzero(of == k)
                    total[:, k] += expected(v.lattice(marked.take(pa.array(own))), p[:, k], n[own])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "mass"])

        cells = (table.mapInArrow(expect, "cell long, mass double").groupBy("cell").agg(F.sum("mass").alias("mass"))
                 .toPandas())
        mass = np.zeros(prob.size)
        mass[cells.cell.to_numpy(np.int64)] = cells.mass.to_numpy(float)
        mass = mass.reshape(prob.shape) + DELTA
        prob = mass / mass.sum(axis=0)
    return prob


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, vocab_path: str) -> DataFrame:
    """All columns of ``docs`` as struct ``doc`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, prob))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for piece in slices(batch):
                w = words(text_column(piece))
                values, code = clean(w.vocab)
                n = len(w.offsets) - 1
                lettered = pc.utf8_length(values).to_numpy(zero_copy_only=False)[code] > 0 if len(code) else np.zeros(0, bool)
                owner = w.owner()
                known = np.bincount(owner[lettered[w.ids]], minlength=n) > 0
                if names:
                    total = np.empty((n, len(names)))
                    for k in range(0, len(names), LANG_GROUP):
                        some = np.ascontiguousarray(p[:, k:k + LANG_GROUP])
                        by_word = word_scores(values, vocab, some, min(40_000, 400_000 // some.shape[1]))[code]
                        for j in range(some.shape[1]):
                            total[:, k + j] = np.bincount(owner, weights=by_word[w.ids, j], minlength=n)
                    best = total.argmax(axis=1)
                    sure = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
                else:
                    known[:], best, sure = False, np.zeros(n, np.int64), np.zeros(n)
                labels = np.array([*names, UNDETERMINED], object)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(labels[np.where(known, best, len(names))], pa.string()),
                     pa.array(np.where(known, sure, 0.0))], ["doc", "lang_pred", "score"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(score, schema)


def language_id(docs: DataFrame, vocab_path: str, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; held-out rows are not learned from."""
    langs, prob = learn(docs.filter(~held_out()), vocab_path, train_chars)
    return (predict(docs.select("doc_id", "text"), langs, prob, vocab_path)
            .select("doc.doc_id", "lang_pred", "score")
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


def keep_identified(docs: DataFrame, vocab_path: str, min_score: float = 0.5) -> DataFrame:
    """Rows whose language is determined with at least ``min_score``, all columns as they were."""
    langs, prob = learn(docs, vocab_path)
    found = predict(docs, langs, prob, vocab_path)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("doc.*")
