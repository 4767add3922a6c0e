"""Ids of public vocabularies, exactly as the tokenizers library gives them, for whole batches.

Neither tokenizer merges across a space, so a batch is cut at spaces, every distinct word is encoded
once, by the merge loop of tiktoken over the same vocabulary, and the ids are laid out again by
NumPy. Texts for which that could differ (special tokens spelled out, double spaces, letters beyond
Latin where a normaliser runs) go through tokenizers itself. Build an encoder once per task.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The patterns by which the two public tokenizers cut a text.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_BETWEEN = "\u3000"  # a space beyond the letters of the quick path
WIDE_BYTES, NARROW_BYTES = 4 << 20, 1 << 20  # for encoders; for NumPy over single bytes


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: int, limit: int = NARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)])) if len(group) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def take_ragged(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[offsets[i]:offsets[i+1]]`` for each i of index; also where each ends."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(lengths)
    shift = offsets[:-1][index] - (ends - lengths)
    return values[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def _bytes_of_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: bytes that print stand for
    themselves, the others follow from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in prints}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(prints))}


class _Encoder:
    """Words to ids. Subclasses set ``_fast``, ``_real`` (ids of its ranks), ``_sizes`` (bytes of
    its ranks), ``_whole`` (a pattern of texts to leave to tokenizers) and ``_spelled``."""

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            self._spec = json.load(f)
        self._exact = Tokenizer.from_file(json_path)
        self._specials = {t["content"] for t in self._spec["added_tokens"]}
        self._raw = _bytes_of_symbols()

    def exact(self, text: str) -> np.ndarray:
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ranked(self, table: list[tuple[bytes, int]], pattern: str) -> None:
        import tiktoken

        self._real = np.array([i for _, i in table], np.uint32)
        self._sizes = np.array([len(b) for b, _ in table], np.int64)
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: r for r, (b, _) in enumerate(table)}, special_tokens={})

    def _spell_all(self, words: list[str]) -> list[str]:
        return [self._spelled(w) for w in words]

    def _words_to_ids(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One run of the merge loop over all words; pieces never cross words, so their byte
        lengths tell where each word ends."""
        ranks = np.array(self._fast.encode_ordinary("".join(spelled)), np.int64)
        word_ends = np.cumsum([len(w.encode()) for w in spelled], dtype=np.int64)
        offsets = np.searchsorted(np.cumsum(self._sizes[ranks]), word_ends, side="right")
        return self._real[ranks], np.concatenate(([0], offsets))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self._whole).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        codes = parts.flatten().dictionary_encode()
        first = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        ids, offsets = self._words_to_ids(self._spell_all(codes.dictionary.to_pylist()))
        index = codes.indices.to_numpy().astype(np.int64)
        index, ids, offsets = self._with_first(texts, whole, parts, first, index, ids, offsets)
        out, ends = take_ragged(ids, offsets, index)
        counts = np.concatenate(([0], ends))[np.append(first, len(index))]
        if not whole.any():
            return out, counts
        rows = np.split(out, counts[1:-1])
        for i in np.flatnonzero(whole):
            rows[i] = self.exact(texts[i].as_py())
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def _with_first(self, texts, whole, parts, first, index, ids, offsets):
        return index, ids, offsets


class ByteEncoder(_Encoder):
    """``byte_bpe``: byte-level BPE without a normaliser; a space belongs to the word behind it."""

    def __init__(self, json_path: str):
        super().__init__(json_path)
        vocab = self._spec["model"]["vocab"]
        self._ranked([(bytes(self._raw[c] for c in p), i) for p, i in sorted(vocab.items(), key=lambda x: x[1])], GPT_PATTERN)
        self._whole = r"  |<\|"

    def _spelled(self, word: str) -> str:
        return " " + word

    def _with_first(self, texts, whole, parts, first, index, ids, offsets):
        """The first word of a text has no space before it."""
        heads = parts.flatten().take(pa.array(first)).dictionary_encode()
        rows = [self._fast.encode_ordinary(w) for w in heads.dictionary.to_pylist()]
        more = np.array([r for row in rows for r in row], np.int64)
        index = index.copy()
        index[first] = heads.indices.to_numpy().astype(np.int64) + len(offsets) - 1
        ends = offsets[-1] + np.cumsum([len(r) for r in rows], dtype=np.int64)
        return index, np.concatenate((ids, self._real[more])), np.concatenate((offsets, ends))


class WordEncoder(_Encoder):
    """``word_bpe``: lower-cased BPE whose last piece of a word carries an end mark.

    The end mark becomes a space behind each word. Words hold no spaces, and joining a byte with the
    space ranks before every other merge, so each word starts from its bytes with a marked last one.
    """

    def __init__(self, json_path: str):
        import regex

        super().__init__(json_path)
        end, vocab = self._spec["model"]["end_of_word_suffix"], self._spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in self._spec["model"]["merges"]]
        pieces = [a + b for a, b in merges]

        def body(piece: str) -> bytes:
            ended = piece.endswith(end) and piece != end
            return bytes(self._raw[c] for c in (piece[: -len(end)] if ended else piece)) + b" " * ended

        other = set(pieces) | self._specials
        basic = [(body(p), i) for p, i in vocab.items() if p not in other]
        basic.sort(key=lambda x: (-len(x[0]), x[1]))  # marked bytes first
        known = {b for b, _ in basic}
        basic += [(bytes([b]), 0) for b in range(256) if bytes([b]) not in known]  # never met: the merge loop wants all bytes
        self._ranked(basic + [(body(p), vocab[p]) for p in pieces], "[^ ]+ ")
        self._words = regex.compile(WORD_PATTERN)
        self._inner_spaces = regex.compile(f"[^\\S {_BETWEEN}]+")
        self._whole = "[^\\x{0}-\\x{24f}\\x{2010}-\\x{203a}]|<\\|"

    def _spell_all(self, words: list[str]) -> list[str]:
        """All words at once: joined by a space that none of them holds, and every piece that the
        pattern finds followed by its end mark."""
        joined = unicodedata.normalize("NFC", _BETWEEN.join(words)).lower()
        marked = self._words.sub(r"\g<0> ", joined)
        return self._inner_spaces.sub("", marked).split(_BETWEEN) if words else []
