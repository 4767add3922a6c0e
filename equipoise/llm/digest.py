"""Improbable-feature digests of documents.

Every window of 32 bytes has an entropy; windows whose entropy is rare in the corpus identify a text
best. A text's windows are ranked by the rarity of their entropy level; in each run of 32 neighbouring
windows the rarest scores a point, and windows with enough points are its features. Features set bits
in a chain of Bloom filters of 2048 bits, at most 128 features each. The likeness of two digests is
the shared bits beyond those expected by chance, as a share of the most possible, averaged over the
shorter digest's filters.

Rarity is counted over all windows of all documents, per entropy level (a table of fixed size, counted
in the map tasks). Texts are dealt by ranges of ``doc_id`` once, for the neighbour: at most 65,536
ranges, whose first keys are looked up by bisection. Everything else stays in its task, in batches of
bounded size; a text above 1 MB is a batch of its own and read in pieces of that size, so it takes a
small multiple of its own bytes.

Cases: a null text counts as empty. A text of up to 32 windows uses all of them, one shorter than a
window is padded to one window; a text of which no window has enough points (few runs, or one level
throughout) uses each of its different windows once. So only an empty text has an empty digest, which
is like nothing but itself.
Rows of equal id are ordered by their texts' hashes. The next of the last document is the first; of
a single one, itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import text_or_empty
from equipoise.llm.words import mix

WINDOW = 32
SPREAD = 32
POINTS = 8
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 128, 4
LEVELS = 512
PART_ROWS, MAX_PARTS = 8_000, 1 << 16
_CHUNK_BYTES = 1 << 20
_UNIT = 1 << 32
_BLOCK = 512  # filters that are compared with as many others at once


def _entropy_table() -> np.ndarray:
    """Fixed-point c*log2(c), so that sums do not depend on their order."""
    c = np.arange(WINDOW + 1)
    return np.round(c * np.log2(np.maximum(c, 1)) * _UNIT).astype(np.int64)


def entropy_levels(raw: np.ndarray) -> np.ndarray:
    """Level of the entropy of every window of one run of bytes, at least ``WINDOW`` long."""
    n, table = len(raw), _entropy_table()
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for step in range(1, WINDOW):
        same = (raw[step:] == raw[:-step]).view(np.uint8)
        back[step:] += same
        ahead[:-step] += same
    enter = table[back + 1] - table[back]
    leave = table[ahead] - table[ahead + 1]
    # The window at s loses byte s and gains byte s + WINDOW, counted among the bytes in between.
    first = table[np.bincount(raw[:WINDOW], minlength=256)].sum()
    change = leave[: n - WINDOW] + enter[WINDOW:]
    total = np.concatenate(([first], first + np.cumsum(change)))
    top = float(table[WINDOW])
    return np.clip(((1 - total / top) * (LEVELS - 1)).round(), 0, LEVELS - 1).astype(np.int64)


def _runs(texts: list[bytes]) -> Iterator[list[int]]:
    """Groups of texts of bounded size; a longer text is a group of its own."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > _CHUNK_BYTES and group:
            yield group
            group, size = [], 0
        group.append(i)
        size += max(len(text), WINDOW)
        if size >= _CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all non-empty texts, padded to a window, with the first window and the number of each."""
    padded = [t.ljust(WINDOW, b"\0") for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    return np.frombuffer(b"".join(padded), np.uint8), np.cumsum(sizes) - sizes, sizes - WINDOW + 1


def _pieces(raw: np.ndarray, margin: int) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """``(bytes, offset, first, last)``: pieces of a text, and which windows of each are its own; up
    to ``margin`` more windows lie on either side."""
    n = len(raw) - WINDOW + 1
    for at in range(0, n, _CHUNK_BYTES):
        low, end = max(0, at - margin), min(n, at + _CHUNK_BYTES)
        yield raw[low : min(n, end + margin) + WINDOW - 1], low, at - low, end - low


def _hashed(raw: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the given places."""
    weights = mix(np.arange(1, WINDOW + 1, dtype=np.uint64))
    out = np.empty(len(windows), np.uint64)
    for at in range(0, len(windows), 50_000):
        part = windows[at : at + 50_000]
        out[at : at + 50_000] = mix((raw[part[:, None] + np.arange(WINDOW)].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64))
    return out


def _bits(hashed: np.ndarray) -> np.ndarray:
    return np.stack([(hashed >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1) for k in range(HASHES)], axis=1).astype(np.int64)


def _least_in_runs(key: np.ndarray) -> np.ndarray:
    """The least of every ``SPREAD`` neighbours, by the first of them."""
    best, width = key, 1
    while width < SPREAD:
        best = np.minimum(best[:-width], best[width:]) if len(best) > width else best
        width *= 2
    return best


def _long_features(text: bytes, rank: np.ndarray) -> np.ndarray:
    """Hashed features of a text of more than ``_CHUNK_BYTES``, in order."""
    raw, found = np.frombuffer(text, np.uint8), []
    for piece, _, first, last in _pieces(raw, SPREAD - 1):
        levels = entropy_levels(piece)
        best = _least_in_runs((rank[levels].astype(np.int64) << 40) | np.arange(len(levels)))
        points = np.bincount(best & ((1 << 40) - 1), minlength=len(levels))
        found.append(_hashed(piece, first + np.flatnonzero(points[first:last] >= POINTS)))
    if any(map(len, found)):
        return np.concatenate(found)
    # No window has enough points: each different window once, where it is first met.
    seen = np.empty(0, np.uint64)
    found = []
    for piece, _, first, last in _pieces(raw, 0):
        kinds, at = np.unique(_hashed(piece, np.arange(first, last)), return_index=True)
        new = ~np.isin(kinds, seen, assume_unique=True)
        found.append(kinds[new][np.argsort(at[new])])
        seen = np.union1d(seen, found[-1])
    return np.concatenate(found)


def digests(texts: list[bytes], rank: np.ndarray) -> list[list[int]]:
    """A chain of Bloom filters (as whole numbers) per text."""
    out: list[list[int]] = [[] for _ in texts]
    for group in _runs(texts):
        own = [i for i in group if texts[i]]
        if not own:
            continue
        if len(own) == 1 and len(texts[own[0]]) > _CHUNK_BYTES:
            hashed = _long_features(texts[own[0]], rank)
            for at in range(0, len(hashed), 50_000):
                some = hashed[at : at + 50_000]
                _insert(out, own, np.zeros(len(some), np.int64), _bits(some))
            continue
        raw, starts, counts = _joined([texts[i] for i in own])
        levels = entropy_levels(raw)
        # Rarest first, then leftmost; windows that reach into the next text never win.
        places = np.arange(len(levels), dtype=np.int64)
        text_of = np.repeat(np.arange(len(own)), np.append(starts[1:], len(raw)) - starts)[: len(levels)]
        inside = places - starts[text_of] < counts[text_of]
        key = (np.where(inside, rank[levels], LEVELS).astype(np.int64) << 40) | places
        best = _least_in_runs(key)
        # A run of neighbours counts only if it lies inside one text.
        runs = np.arange(len(best))
        fits = runs + SPREAD - 1 - starts[text_of[runs]] < counts[text_of[runs]] if len(levels) >= SPREAD else np.zeros(len(best), bool)
        points = np.bincount(best[fits] & ((1 << 40) - 1), minlength=len(levels))
        scored = inside & (points >= POINTS)
        short = counts <= SPREAD
        plain = ~short & (np.bincount(text_of[scored], minlength=len(own)) == 0)
        chosen = np.flatnonzero(scored | (inside & (short | plain)[text_of]))
        hashed = _hashed(raw, chosen)
        keep = _first_of_each(hashed, text_of[chosen], plain)
        chosen, hashed = chosen[keep], hashed[keep]
        for at in range(0, len(chosen), 50_000):
            part, some = chosen[at : at + 50_000], hashed[at : at + 50_000]
            _insert(out, own, text_of[part], _bits(some))
    return [[int.from_bytes(np.packbits(f).tobytes(), "big") for f, _ in chain] for chain in out]


def _first_of_each(hashed: np.ndarray, texts: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Which windows stay: of a plain text the first of each content, of others all."""
    keep = ~plain[texts]
    some = np.flatnonzero(~keep)
    order = some[np.lexsort((some, hashed[some], texts[some]))]
    if len(order):
        keep[order] = np.concatenate(([True], (hashed[order[1:]] != hashed[order[:-1]]) | (texts[order[1:]] != texts[order[:-1]])))
    return keep


def _insert(out: list, own: list[int], rows: np.ndarray, bits: np.ndarray) -> None:
    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True]))) if len(rows) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        chain = out[own[rows[a]]]
        while a < b:
            if not chain or chain[-1][1] >= FILTER_FEATURES:
                chain.append((np.zeros(FILTER_BITS, np.uint8), 0))
            filter_, used = chain[-1]
            some = bits[a : min(b, a + FILTER_FEATURES - used)]
            filter_[some] = 1
            chain[-1] = (filter_, used + len(some))
            a += len(some)


def likeness(a: list[int], b: list[int]) -> float:
    """0 to 1; every filter of the shorter digest takes its best match of the longer."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    known = set(long)
    # A filter that the other digest has too is as like as can be.
    rest = [x for x in short if x not in known]
    total = float(len(short) - len(rest)) + (_best_matches(rest, long) if rest else 0.0)
    return max(0.0, min(1.0, total / len(short)))


def _best_matches(short: list[int], long: list[int]) -> float:
    """Sum over ``short`` of the best match in ``long``."""
    if len(short) * len(long) <= 64:
        long_set, total = [(y, y.bit_count()) for y in long], 0.0
        for x in short:
            n = x.bit_count()
            total += max(_match((x & y).bit_count(), n, m) for y, m in long_set)
        return total
    total = 0.0
    for at in range(0, len(short), _BLOCK):
        left = _unpacked(short[at : at + _BLOCK])
        n, best = left.sum(axis=1)[:, None].astype(np.float64), np.zeros(len(left))
        for by in range(0, len(long), _BLOCK):
            right = _unpacked(long[by : by + _BLOCK])
            m = right.sum(axis=1)[None, :].astype(np.float64)
            shared, room = (left @ right.T).astype(np.float64), np.minimum(n, m) * (1 - np.maximum(n, m) / FILTER_BITS)
            alike = np.divide(shared - n * m / FILTER_BITS, room, out=(shared >= np.maximum(n, m)).astype(np.float64), where=room > 0)
            best = np.maximum(best, alike.max(axis=1))
        total += float(best.sum())
    return total


def _match(shared: int, n: int, m: int) -> float:
    """Shared bits beyond chance, as a share of the most possible."""
    chance, most = n * m / FILTER_BITS, min(n, m)
    return max(0.0, (shared - chance) / (most - chance)) if most > chance else float(shared == n == m)


def _unpacked(filters: list[int]) -> np.ndarray:
    data = b"".join(f.to_bytes(FILTER_BITS // 8, "big") for f in filters)
    return np.unpackbits(np.frombuffer(data, np.uint8)).reshape(len(filters), FILTER_BITS).astype(np.float32)


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy level by its count over all windows of all documents, rarest first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LEVELS, np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            for group in _runs(texts):
                if len(group) == 1:
                    raw = np.frombuffer(texts[group[0]].ljust(WINDOW, b"\0"), np.uint8)
                    for piece, _, _, _ in _pieces(raw, 0):
                        sums += np.bincount(entropy_levels(piece), minlength=LEVELS)
                    continue
                raw, starts, counts = _joined([texts[i] for i in group])
                first = np.zeros(len(raw) + 1, np.int64)
                first[starts] += 1
                first[starts + counts] -= 1
                levels = entropy_levels(raw)
                sums += np.bincount(levels[np.cumsum(first)[: len(levels)] > 0], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(sums)], ["level", "windows"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "level int, windows bigint")
    windows = np.zeros(LEVELS, np.int64)
    for level, n in rows.groupBy("level").agg(F.sum("windows")).collect():  # LEVELS rows
        windows[level] = n
    order = np.lexsort((np.arange(LEVELS), np.where(windows > 0, windows, np.iinfo(np.int64).max)))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _order_key(id_: Column, tie: Column) -> Column:
    """16 bytes that compare as ``(id, tie)`` do."""
    sign = F.lit(-(1 << 63)).cast("bigint")
    return F.unhex(F.concat(*[F.lpad(F.hex(c.bitwiseXOR(sign)), 16, "0") for c in (id_, tie)]))


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows ``(part, place, doc_id, text)`` dealt by descending id; every part also holds the first
    document behind it, marked by ``place`` 1."""
    id_, tie = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")), F.xxhash64(text_or_empty())
    parts = min(max(1, docs.count() // PART_ROWS), MAX_PARTS)
    # Keys alone are dealt by range; the first of each part reach the driver, at most MAX_PARTS rows of 16 bytes.
    keys = docs.select(_order_key(id_, tie).alias("me")).repartitionByRange(parts, F.desc("me"))
    firsts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max("me").alias("head")).collect()
    heads = sorted((bytes(r.head) for r in firsts), reverse=True)
    packed = F.lit(bytearray(b"".join(heads)))

    def head(at: Column) -> Column:
        return F.substring(packed, at * 16 + 1, F.lit(16))

    # Heads descend; the last that is not behind a row begins its part. Beyond the last one there is none.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(heads)).bit_length()))])
    rows = docs.select("doc_id", text_or_empty().alias("text"), _order_key(id_, tie).alias("me"))
    rows = rows.withColumn("part", F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(head(at + step) >= F.col("me"), step).otherwise(0)))
    before = F.when(F.col("part") == 0, len(heads) - 1).otherwise(F.col("part") - 1)
    own = F.struct(F.col("part"), F.lit(0).alias("place"))
    places = F.when(head(F.col("part")) == F.col("me"), F.array(own, F.struct(before.alias("part"), F.lit(1).alias("place")))).otherwise(F.array(own))
    out = rows.select("doc_id", "me", "text", F.explode(places).alias("at")).select("at.part", "at.place", "doc_id", "me", "text")
    return out.repartition(parts, "part").sortWithinPartitions("part", "place", F.desc("me"))


def digest_documents(docs: DataFrame) -> DataFrame:
    """Digests of every text and of its edited form, and how like they are; see the contract's columns."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity_ranks(docs))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def spell(chain: list[int]) -> str:
        return ".".join(f"{f:0{FILTER_BITS // 4}x}" for f in chain)

    def flush(rank: np.ndarray, docs_: list[tuple], nexts: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in docs_]
        edited = []
        for text, after in zip(texts, nexts):
            n = len(text) // 3
            edited.append(text[: len(text) - n] + after[:n])
        own = digests([t.encode() for t in texts] + [nexts[-1].encode()], rank)
        changed = digests([t.encode() for t in edited], rank)
        columns = [
            [d for d, _ in docs_],
            [len(t) for t in texts],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [spell(f) for f in own[:-1]],
            [spell(f) for f in changed],
            [likeness(a, b) for a, b in zip(own, changed)],
            [likeness(a, b) for a, b in zip(own, own[1:])],
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, held, size = shared.value, None, [], 0
        for batch in batches:
            for now, place, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part:
                    part, held, size = now, [], 0
                # The held documents and their successors: the last held one waits for its own.
                if held and (place == 1 or size >= 2 << 20):
                    yield flush(rank, held, [t for _, t in held[1:]] + [text])
                    held, size = [], 0
                if place == 0:
                    held.append((doc_id, text))
                    size += len(text)

    rows = _with_neighbours(docs).select("part", "place", "doc_id", "text")
    return rows.mapInArrow(walk, schema)
