"""Exact ids of a public tokenizer, each distinct stretch of text encoded once.

Both vocabularies break a text before BPE in a way that never depends on what
lies beyond a word break, so a text is cut there, equal stretches are encoded
once per worker and the ids are put together again.  The result equals
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` of the
whole text.  An added token's string in a text is that token, as the library
has it; such strings hold no white space, so no cut falls inside one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohorta.llm.tokens import hash_strings, per_doc, ragged, raw_bytes, words

#: Stretches kept per Python worker; beyond it new ones are encoded each time.
CACHE_ENTRIES = 1_000_000
#: Longer stretches (in bytes) are encoded but not kept.
CACHE_BYTES = 48
#: Stretches that the library is given as one text, between added tokens.
JOINED = 2_000


def byte_segments(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut before each space between two visible characters.

    Returns offsets of the segments of each document and the segments.  The
    byte-level pattern starts a new piece at such a space whatever surrounds
    it.  Characters that might be Unicode white space are never cut at.
    """
    data, off = raw_bytes(texts)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        before, after = data[:-2], data[2:]
        visible = (before > 0x20) & (before < 0x7F)
        two = np.zeros(n, np.uint8)
        two[1:] = data[:-1]                     # byte before the one at i
        lead2 = two[:-2]
        three = np.zeros(n, np.uint8)
        three[2:] = data[:-2]
        lead3 = three[:-2]
        tail = (before >= 0x80) & (before < 0xC0)
        visible |= tail & (lead2 >= 0xC3) & (lead2 < 0xE0)
        visible |= tail & (lead2 >= 0x80) & (lead2 < 0xC0) & (lead3 >= 0xE4) & (lead3 < 0xF0)
        starts = ((after > 0x20) & (after < 0x7F)) | ((after >= 0xC3) & (after < 0xE0)) | (after >= 0xE4)
        cut[1:n - 1] = (data[1:-1] == 0x20) & visible & starts
    cut[off] = True
    at = np.flatnonzero(cut)
    if at[-1] != n:
        at = np.append(at, n)
    doc_off = np.searchsorted(at, off)
    # empty documents share an offset; segments are the runs between cuts
    buf = pa.py_buffer(np.ascontiguousarray(at, np.int64))
    segs = pa.LargeStringArray.from_buffers(len(at) - 1, buf, pa.py_buffer(np.ascontiguousarray(data)))
    return doc_off, segs


class Known:
    """Stretches and their ids, found by hash and told apart by their bytes."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)          # sorted hashes, and which entry each belongs to
        self.entry = np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(1 << 16, np.uint8), np.zeros(CACHE_ENTRIES + 1, np.int64)
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(CACHE_ENTRIES + 1, np.int64)
        self.n = 0

    def find(self, keys: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Entry of each stretch, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        place = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        like = np.flatnonzero(self.keys[place] == keys)
        entry = self.entry[place[like]]
        size = np.diff(off)[like]
        same = size == self.text_at[entry + 1] - self.text_at[entry]
        like, entry, size = like[same], entry[same], size[same]
        differs = data[ragged(off[:-1][like], size)] != self.text[ragged(self.text_at[entry], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        equal = per_doc(differs, ends) == 0
        out[like[equal]] = entry[equal]
        return out

    def add(self, keys: np.ndarray, data: np.ndarray, off: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Keep stretches that are not too long, as many as there is room for.  Of equal hashes the first stays."""
        size = np.diff(off)
        own, first = np.unique(keys, return_index=True)
        taken = self.keys[np.minimum(np.searchsorted(self.keys, own), self.n - 1)] == own if self.n else False
        first = np.sort(first[(size[first] <= CACHE_BYTES) & ~np.asarray(taken)])[:CACHE_ENTRIES - self.n]
        if not len(first):
            return
        size, count = size[first], np.diff(at)[first]
        self.text = self._room(self.text, int(self.text_at[self.n]), data[ragged(off[:-1][first], size)])
        self.flat = self._room(self.flat, int(self.at[self.n]), ids[ragged(at[:-1][first], count)])
        last = self.n + len(first)
        self.text_at[self.n + 1:last + 1] = self.text_at[self.n] + np.cumsum(size)
        self.at[self.n + 1:last + 1] = self.at[self.n] + np.cumsum(count)
        merged = np.concatenate([self.keys, keys[first]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.entry = merged[order], np.concatenate([self.entry, np.arange(self.n, last)])[order]
        self.n = last

    @staticmethod
    def _room(buffer: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(buffer):
            buffer = np.concatenate([buffer, np.zeros(len(buffer) + len(more), buffer.dtype)])
        buffer[used:used + len(more)] = more
        return buffer


class SegmentEncoder:
    """Ids of stretches of text, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.by_word = self._drops_space()
        self.known = Known()
        # the library cuts a text at added tokens before all else, so one of them can stand between stretches
        self.marks = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()
                      if not (t.lstrip or t.rstrip or t.single_word)}

    def _drops_space(self) -> bool:
        return not self.tok.encode("\n ", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of new stretches: many to a text, with an added token in between."""
        n = len(values)
        own = np.ones(n, bool)
        if self.marks:
            mark = min(self.marks)
            # a stretch with a part of an added token in it is encoded by itself
            own = pc.match_substring(values, "<|").to_numpy(zero_copy_only=False).astype(bool)
        alone, rest = np.flatnonzero(own), np.flatnonzero(~own)
        parts, sizes = [], np.zeros(n, np.int64)
        if len(rest):
            plain = values.take(pa.array(rest))
            cuts = np.append(np.arange(0, len(rest), JOINED), len(rest)).astype(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(cuts), plain)
            for k, ids in enumerate(self._ids(pc.binary_join(lists, pa.scalar(mark, plain.type)).to_pylist())):
                edge = np.flatnonzero(ids == self.marks[mark])
                sizes[rest[cuts[k]:cuts[k + 1]]] = np.diff(np.concatenate([[-1], edge, [len(ids)]])) - 1
                parts.append(np.delete(ids, edge))
        for i, ids in zip(alone, self._ids(values.take(pa.array(alone)).to_pylist()) if len(alone) else []):
            sizes[i] = len(ids)
            parts.append(ids)
        flat = np.concatenate([np.zeros(0, np.uint32), *parts])
        # back to the order of the values
        order = np.concatenate([rest, alone])
        ends = np.cumsum(sizes[order])
        start = np.empty(n, np.int64)
        start[order] = ends - sizes[order]
        return flat[ragged(start, sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def vocabulary(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) with one run for each value."""
        values = values.cast(pa.large_string())
        data, off = raw_bytes(values)
        keys = hash_strings(values)
        entry = self.known.find(keys, data, off)
        hit, miss = entry >= 0, np.flatnonzero(entry < 0)
        used = int(self.known.at[self.known.n])
        start, size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        start[hit] = self.known.at[entry[hit]]
        size[hit] = self.known.at[entry[hit] + 1] - start[hit]
        if not len(miss):
            return self.known.flat[:used], start, size
        new = values.take(pa.array(miss))
        fresh, at = self._encode(new)
        start[miss], size[miss] = at[:-1] + used, np.diff(at)
        flat = np.concatenate([self.known.flat[:used], fresh])
        new_data, new_off = raw_bytes(new)
        self.known.add(keys[miss], new_data, new_off, fresh, at)
        return flat, start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of whole texts (large_string, offset 0, no null)."""
        if self.by_word:
            w = words(texts)
            seg_off, codes, vocab = w.offsets, w.ids, w.vocab
        else:
            seg_off, segs = byte_segments(texts)
            coded = segs.dictionary_encode()
            codes, vocab = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        flat, start, size = self.vocabulary(vocab)
        sizes = size[codes]
        ids = flat[ragged(start[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[seg_off]


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    """Where a public vocabulary file lies (installed beside Python on every node)."""
    import public_tokenizers
    return public_tokenizers.path(name)
