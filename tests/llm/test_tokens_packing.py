"""Tokenizer, bit packing and best-fit packing against plain versions and round trips."""

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohorta.llm import bitpack as B
from cohorta.llm import packing as P
from cohorta.llm.tokenizer import SegmentEncoder
from cohorta.llm.tokens import words

ALPHABET = "ab Z'é   \n\t  ß.!1٣漢😀́  　'st're<|endoftext|>\u0085\x1c"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_encode_like_whole_texts(vocab, name):
    from tokenizers import Tokenizer
    rng = random.Random(2)
    texts = ["", " ", "\n\n a  b"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(1500)]
    plain = Tokenizer.from_file(vocab(name))
    plain.encode_special_tokens = True
    enc = SegmentEncoder(vocab(name))
    for _ in range(2):                                # the second time from the cache
        ids, off = enc.encode(pa.array(texts, pa.large_string()))
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(vocab, name):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocab(name))
    assert not any(c.isspace() for t in plain.get_added_tokens_decoder().values() for c in t.content)
    added = ["<|endoftext|>", "<|startoftext|>"]
    rng = random.Random(5)
    parts = [*ALPHABET, *added * 6, "<|endof", "text|>", " word", "ing ", "<|EndOfText|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>  y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    enc = SegmentEncoder(vocab(name))
    for _ in range(2):
        ids, off = enc.encode(pa.array(texts, pa.large_string()))
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert plain.token_to_id("<|endoftext|>") in ids[off[0]:off[1]]


def test_words_are_runs_between_ascii_white_space():
    import re
    texts = ["", " a b ", "x\x0by\x1cz", " q w", "end\n", "\n"]
    w = words(pa.array(texts, pa.large_string()))
    vocab = w.vocab.to_pylist()
    for i, t in enumerate(texts):
        assert [vocab[k] for k in w.ids[w.offsets[i]:w.offsets[i + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 25, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1001).astype(np.uint32)
    data = B.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (B.unpack(data, 1001, bits) == ids).all()
    assert B.bits_for(2**bits) == bits and B.bits_for(2**bits + 1) == bits + 1


def test_random_access(tmp_path):
    uri = f"file://{tmp_path}/x.bits"
    rng = np.random.default_rng(1)
    w = B.Writer(uri, 13, block=64)
    parts = [rng.integers(0, 2**13, n).astype(np.uint32) for n in (5, 200, 0, 64, 63)]
    for k in range(2):
        ids = np.concatenate(parts[k::2])
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts[k::2]])])
        w.append(np.arange(len(off) - 1), np.zeros(len(off) - 1, bool), ids, off)
    w.close()
    whole = np.concatenate(parts[0::2] + parts[1::2])
    r = B.Reader(uri)
    for a in range(0, len(whole) + 1, 7):
        for b in (a, a + 1, min(a + 130, len(whole)), len(whole)):
            assert (r.ids(a, b) == whole[a:b]).all()


def plain_ids(vocab, name, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocab(name))
    tok.encode_special_tokens = True
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def test_bit_packed_query(spark, docs, vocab):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for r, ids in zip(rows, plain_ids(vocab, "byte_bpe_50k.json", [r.text for r in rows])):
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = B.read_documents(B.write_files(docs.repartition(3), vocab("byte_bpe_50k.json"), 16, file_ids=20_000))
    assert sorted(map(tuple, got.collect())) == want


def test_bit_packed_odd_rows(odd, none, vocab):
    got = B.bit_packed(odd, vocab("byte_bpe_50k.json"), 50_257).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3))
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0, *[r.n_tokens for r in order]])[:-1])
    keys = [r.doc_id if r.doc_id is not None else -1 for r in order]
    assert keys == sorted(keys)
    assert B.bit_packed(none, vocab("byte_bpe_50k.json"), 50_257).count() == 0


def serial(lengths, capacity):
    """Best-fit decreasing, one piece after another: number of sequences."""
    left = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, n)
        bisect.insort(left, (left.pop(i) if i < len(left) else capacity) - n)
    return len(left)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_serial_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100, 2048])
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.8) * capacity / 30))) for _ in range(rng.randrange(1, 900))]
    hist = {n: lengths.count(n) for n in set(lengths)}
    table = P.plan(hist, capacity)
    bins = {}
    for length, count in hist.items():
        rows = [r for r in table.tolist() if r[0] == length]
        for rank in range(count):
            r = max((x for x in rows if x[1] <= rank), key=lambda x: x[1])
            nth = rank - r[1]
            bins.setdefault(r[3] + nth // r[2], []).append((r[4] + nth % r[2] * length, length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == serial(lengths, capacity)


def test_tree_finds_the_tightest():
    rng = random.Random(0)
    tree, have = P.CapacityTree(100), {}
    for _ in range(3000):
        n = rng.randrange(1, 101)
        if rng.random() < .5:
            tree.add(n, 0, 1)
            have[n] = have.get(n, 0) + 1
        else:
            best = min((k for k in have if k >= n), default=-1)
            assert tree.tightest(n) == best
            if best > 0:
                tree.take(best)
                have[best] -= 1
                if not have[best]:
                    del have[best]


def test_packing_query(spark, docs, odd, none, vocab):
    both = docs.select("doc_id", "text").unionByName(odd.filter("doc_id = 5").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = both.collect()
    want = {}
    for r, ids in zip(rows, plain_ids(vocab, "word_bpe_49k.json", [r.text for r in rows])):
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048] = (k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
    got = P.pack_sequences(both.repartition(4), vocab("word_bpe_49k.json")).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0, *[n for _, n in sorted(places)]])[:-1])
        assert sum(n for _, n in places) <= 2048
    assert len(sequences) == serial([r.length for r in got], 2048)
    assert P.pack_sequences(none, vocab("word_bpe_49k.json")).count() == 0
    assert len({(r.sequence_id, r.offset) for r in P.pack_sequences(odd, vocab("word_bpe_49k.json")).collect()}) >= odd.count()
