"""Token counts of a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at a place of a word; dynamic
programming carries the best score and its piece count from place to place. Ties follow the public
tokenizer exactly: candidates are tried from the leftmost start on, and only a better score replaces
an earlier one. A character that no piece covers alone is unknown, at the least score minus ten;
unknown characters in a row are one piece.

Spaces mark the beginning of words and pieces never cross them, so a text's count is the sum of its
words' counts. Every distinct word of a batch is solved once. Texts are read in one pass without a
shuffle; a task holds the vocabulary, one batch and a cache of at most ``CACHED`` words.

Cases: a null text counts as empty, an empty text has no tokens. Rows that repeat are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import text_or_empty
from equipoise.llm.encoding import WIDE_BYTES, public_path, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 400_000


def ranked_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a public model with Zipf scores: the k-th piece has -ln(k + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), -math.log(k + 2)) for k, i in enumerate(ids)]


class PieceCounter:
    """Piece counts of words under a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in self._automaton.iter(word):
            ends[last + 1].append(match)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, start, single = None, 0, False
            for length, own in sorted(ends[end], reverse=True):  # leftmost start first
                single = single or length == 1
                value = own + score[end - length]
                if best is None or value > best:
                    best, start = value, end - length
            last_unknown = False
            if not single:
                value = self._unknown + score[end - 1]
                if best is None or value > best:
                    best, start, last_unknown = value, end - 1, True
            score[end] = best
            pieces[end] = pieces[start] + (not (last_unknown and unknown[start]))
            unknown[end] = last_unknown
        return pieces[n]


def count_batch(counter: PieceCounter, cache: dict[str, int], texts: pa.Array) -> np.ndarray:
    """Pieces of every text of a batch."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    parts = pc.split_pattern(texts, " ")
    codes = parts.flatten().dictionary_encode()
    counts = np.empty(len(codes.dictionary), np.int64)
    for i, word in enumerate(codes.dictionary.to_pylist()):
        known = cache.get(word)
        if known is None:
            known = counter.count(MARK + word)
            if len(cache) < CACHED:
                cache[word] = known
        counts[i] = known
    each = counts[codes.indices.to_numpy()] if len(codes) else np.empty(0, np.int64)
    first = np.asarray(parts.offsets) - parts.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
    # A mark is put before the text only if it does not begin with one already.
    leading = pc.starts_with(texts, " ").to_numpy(zero_copy_only=False).astype(bool)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
    each[first[:-1][leading | empty]] = 0
    sums = np.concatenate(([0], np.cumsum(each)))
    return sums[first[1:]] - sums[first[:-1]]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, cache = None, {}
        for big in batches:
            for batch in slices(big, 1, WIDE_BYTES):
                counter = counter or PieceCounter(ranked_vocabulary(public_path(vocabulary)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_batch(counter, cache, batch.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_tokens bigint")
