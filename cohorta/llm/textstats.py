"""Per-document counts of a slice of texts (shared by quality rules and classifier)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohorta.llm.tokens import Words, mix, per_doc, raw_bytes, windows, words

#: Symbols of the base rule (fixed value).
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_letters", "n_upper", "n_digits", "n_bare", "n_ends", "n_again")


def repeated_words(w: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words inside ``k``-word windows that a document holds twice or more."""
    key, off = windows(w.ids.astype(np.uint64) + np.uint64(1), w.offsets, k)
    made = np.diff(off)
    doc = np.repeat(np.arange(len(made)), made)
    key = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    hit = order[same]
    start = hit - off[doc[hit]] + w.offsets[doc[hit]]
    edge = np.zeros(len(w.ids) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + k, -1)
    return per_doc((np.cumsum(edge)[:-1] > 0).astype(np.int64), w.offsets)


def again(w: Words) -> np.ndarray:
    """Words equal to the word before them."""
    same = np.zeros(len(w.ids), np.int64)
    same[1:] = w.ids[1:] == w.ids[:-1]
    first = w.offsets[:-1][w.counts > 0]
    same[first] = 0
    return per_doc(same, w.offsets)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line) of each document."""
    parts = pc.split_pattern(texts, "\n")
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    coded = parts.flatten().dictionary_encode()
    full = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    has = full[ids]
    lines = per_doc(has.astype(np.int64), off)
    pair = np.unique(doc[has] * np.int64(max(len(full), 1)) + ids[has])
    distinct = np.bincount(pair // max(len(full), 1), minlength=len(off) - 1)
    return lines, lines - distinct


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """All ``FIELDS`` for each text (large_string without nulls)."""
    w = words(texts)
    data, off = raw_bytes(texts)
    lut = np.zeros(256, np.uint8)
    lut[[ord(c) for c in SYMBOLS]] = 1

    def over_vocab(pattern: str | None) -> np.ndarray:
        if not len(w.vocab):
            return np.zeros(len(w.offsets) - 1, np.int64)
        v = pc.utf8_length(w.vocab) if pattern is None else pc.count_substring_regex(w.vocab, pattern)
        return per_doc(v.to_numpy(zero_copy_only=False).astype(np.int64)[w.ids], w.offsets)

    lines, dups = line_counts(texts)
    return {
        "n_words": w.counts, "word_chars": over_vocab(None),
        "n_symbols": per_doc(lut[data], off),
        "n_dup_lines": dups, "n_repeat_words": repeated_words(w), "n_lines": lines,
        "n_letters": over_vocab(r"\p{L}"), "n_upper": over_vocab(r"\p{Lu}"),
        "n_digits": over_vocab(r"\p{Nd}"),
        "n_bare": over_vocab(r"^[^\p{L}\p{Nd}]+$"),      # words without letter or digit
        "n_ends": over_vocab(r"[^\p{L}\p{Nd}]$"),        # words that end in punctuation
        "n_again": again(w),
    }
