"""Forward algorithm against listing all segmentations, and held-out accuracy."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import lit

from cohorta.llm import language_id as L


def segmentations(word, known, other):
    """All ways to cut ``word`` into pieces, as lists of ids."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        piece = known.get(word[:k], other if k == 1 else None)
        if piece is not None:
            for rest in segmentations(word[k:], known, other):
                yield [piece, *rest]


def test_forward_sums_all_segmentations(vocab):
    v = L.vocabulary(vocab(L_VOCAB))
    known = {p: i for i, p in enumerate(v.pieces)}
    rng = np.random.default_rng(0)
    prob = rng.random((v.other + 1, 3))
    values = ["the", "ñandú", "zq漢x", "a", "information"]
    marked = [L.START + x for x in values]
    lat = v.lattice(pa.array(marked, pa.large_string()))
    got = L.forward(lat, prob)[lat.first + lat.size]
    for i, word in enumerate(marked):
        ways = list(segmentations(word, known, v.other))
        want = sum(np.prod(prob[w], axis=0) for w in ways)
        assert np.allclose(got[i], want)
        # expected counts: each way weighs its share
        mass = np.zeros(v.other + 1)
        for w in ways:
            np.add.at(mass, w, np.prod(prob[w, 0]) / sum(np.prod(prob[x, 0]) for x in ways))
        one = v.lattice(pa.array([word], pa.large_string()))
        assert np.allclose(L.expected(one, prob[:, 0], np.array([3.0])), 3 * mass)


L_VOCAB = "piece_bpe_32k.model"


def test_held_out_accuracy(spark, vocab):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.language_id(docs, vocab(L_VOCAB)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99


def test_training_is_bounded_and_spares_held_out(spark, vocab, docs):
    langs, prob = L.learn(docs, vocab(L_VOCAB), train_chars=2000)
    assert langs == sorted(langs) and np.allclose(prob.sum(axis=0), 1) and (prob > 0).all()


def all_segmentations(word, v, prob):
    """Sum over all segmentations in exact arithmetic."""
    known = {p: i for i, p in enumerate(v.pieces)}
    at = [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - v.longest), end):
            piece = known.get(word[start:end], v.other if end - start == 1 else None)
            if piece is not None:
                at[end] += at[start] * Fraction(prob[piece])
    return at[-1]


def log_of(x):
    """Natural logarithm of a fraction of any size."""
    shift = x.denominator.bit_length() - x.numerator.bit_length()
    return math.log(float(x * 2 ** shift)) - shift * math.log(2)


def test_whole_vocabulary(vocab):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab(L_VOCAB))
    every = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if any(c.isalpha() for c in sp.id_to_piece(i))
             and not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    v = L.vocabulary(vocab(L_VOCAB))
    assert every <= set(v.pieces) and v.longest == max(map(len, every)) > 10
    lat = v.lattice(pa.array(["▁information"], pa.large_string()))
    assert "▁information" in {v.pieces[i] for i in lat.piece if i < v.other}


def test_long_words_sum_all_segmentations(vocab):
    v = L.vocabulary(vocab(L_VOCAB))
    rng = np.random.default_rng(5)
    prob = rng.random((v.other + 1, 2)) ** 6
    prob /= prob.sum(axis=0)
    text = "theinformationofgovernmentsandñandúuniversityofthe漢字かな"
    words = [(text * 10)[:n] for n in (1, 21, 39, 40, 41, 80, 400)] + ["ꙮ" * 130, "x" * 300]
    for block in (None, 4, 17):
        if block is None:
            got = L.word_scores(pa.array(words), v, prob)
        else:
            got = L.long_scores([L.START + w for w in words], v, prob, block)
        for i, w in enumerate(words):
            for k in (0, 1):
                assert abs(got[i, k] - log_of(all_segmentations(L.START + w, v, prob[:, k]))) < 1e-6 * len(w)


def test_scripts_outside_the_vocabulary_are_told_apart(vocab):
    v = L.vocabulary(vocab(L_VOCAB))
    prob = np.full((v.other + 1, 2), 1e-5)
    prob[v.other] = [1e-8, 3e-8]
    for n in (20, 40, 500):
        a, b = L.word_scores(pa.array(["ꙮ" * n]), v, prob)[0]
        assert np.isfinite([a, b]).all() and b - a > n        # log 3 a letter


def test_long_words_are_learned_whole(spark, vocab):
    # equal up to the first letters; only what follows tells the languages apart
    rows = [(i, "x" * 40 + ("ab", "cd")[i % 2] * 300, ("aa", "bb")[i % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prob = L.learn(df, vocab(L_VOCAB))
    got = {r.doc.doc_id: r.lang_pred for r in L.predict(df, langs, prob, vocab(L_VOCAB)).collect()}
    assert got == {i: lang for i, _, lang in rows}
    # as many characters as there are
    cut, of = L.stretches(pa.array(["a", "", "漢" * 95]), 40)
    assert cut.to_pylist() == ["▁a", "▁" + "漢" * 40, "漢" * 40, "漢" * 15] and of.tolist() == [0, 2, 2, 2]


def test_expected_counts_of_long_words(vocab):
    """Forward-backward of a word far beyond what products of doubles can hold."""
    v = L.vocabulary(vocab(L_VOCAB))
    prob = np.full(v.other + 1, 1e-6)
    word = L.START + "ab" * 500
    got = L.expected(v.lattice(pa.array([word], pa.large_string())), prob, np.array([2.0]))
    letters = np.array([len(p) for p in v.pieces] + [1])
    assert np.isfinite(got).all() and abs((got * letters).sum() - 2 * len(word)) < 1e-6


def test_every_language_is_learned(spark, vocab):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(26, size=9)) for _ in range(206)]
    rows = [(i, f"{w} {w} " * (1 if i == 205 else 3), f"l{i:03}") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prob = L.learn(df, vocab(L_VOCAB), rounds=1)
    assert langs == [lang for _, _, lang in rows] and np.allclose(prob.sum(axis=0), 1)
    got = {r.doc.doc_id: r.lang_pred for r in L.predict(df, langs, prob, vocab(L_VOCAB)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_odd_rows(odd, none, vocab, spark):
    got = {r.doc_id: r for r in L.language_id(odd, vocab(L_VOCAB)).collect()}
    for i in (2, 3, 4, 7):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1].lang_pred == got[6].lang_pred in ("en", "de") and got[8].lang_pred != "und"
    unlabelled = odd.withColumn("lang", lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_id(unlabelled, vocab(L_VOCAB)).collect()} == {"und"}
    kept = L.keep_identified(odd, vocab(L_VOCAB))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 6, None}
    assert L.language_id(none, vocab(L_VOCAB)).count() == 0 and L.keep_identified(none, vocab(L_VOCAB)).count() == 0
