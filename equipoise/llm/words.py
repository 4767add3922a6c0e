"""Hashes of words and word shingles for whole Arrow batches, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x100000001B3


def _table(kind: str) -> np.ndarray:
    inside = np.ones(256, bool)
    if kind == "spaces":
        inside[[9, 10, 11, 12, 13, 32]] = False
    else:
        inside[:128] = [chr(b).isalnum() for b in range(128)]
    return inside


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values * _MULTIPLIER
    values ^= values >> np.uint64(31)
    values *= _FINAL
    return values ^ (values >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * _BASE % (1 << 64)
    return out


def word_spans(texts: pa.Array, between: str = "spaces", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends, offsets)``: words of all texts, and where each text's words begin.

    ``between`` is what separates words: ASCII white space (``spaces``), or every ASCII character
    that is no letter or digit (``marks``).
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _table(between)[raw]
    before = np.concatenate(([False], inside[:-1]))
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True  # words end where a text ends
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return raw, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array, between: str = "spaces", lower: bool = True, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word (or of its first ``prefix`` bytes), and each text's first word."""
    raw, starts, ends, offsets = word_spans(texts, between, lower)
    return span_hashes(raw, starts, np.minimum(ends, starts + prefix) if prefix else ends), offsets


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, none of them empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inner = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = raw[np.repeat(starts, lengths) + inner].astype(np.uint64) + np.uint64(1)
    values *= _powers(int(lengths.max()))[inner]
    return mix(np.add.reduceat(values, first))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row and the text of each; a shorter text is one shingle."""
    counts = np.diff(offsets)
    padded = np.where(counts > 0, np.maximum(counts, size), 0)
    starts = np.cumsum(padded) - padded
    words = np.zeros(int(padded.sum()) + size, np.uint64)
    words[np.repeat(starts - offsets[:-1], counts) + np.arange(len(hashes))] = hashes
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words[i : len(words) - size + 1 + i]
    rows = np.repeat(np.arange(len(counts)), np.where(counts > 0, padded - size + 1, 0))
    per_row = np.where(counts > 0, padded - size + 1, 0)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return mix(total[starts[rows] + inner]), rows


def counted(hashes: np.ndarray, rows: np.ndarray, bits: int = 44) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (shortened to ``bits``) of every text with their counts: ``(hash, row, count)``.
    A batch may hold up to 2^(64-bits) texts."""
    shift = np.uint64(bits)
    keys = np.sort((rows.astype(np.uint64) << shift) | (hashes >> np.uint64(64 - bits)))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    kinds = keys[first]
    counts = np.diff(np.append(first, len(keys)))
    return kinds & ((np.uint64(1) << shift) - np.uint64(1)), (kinds >> shift).astype(np.int64), counts
