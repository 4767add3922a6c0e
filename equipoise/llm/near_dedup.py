"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles (lower case, words between white space): a
shingle's weight is its count in the text times an inverse document frequency between 1 and 2. Texts
are alike if their weighted Jaccard similarity is 0.8 or more.

1. A shingle weighs 2 if at most R documents hold it, 1 if all N do, and 1 + log(N/n)/log(N/R) if n
   do; R is a 2^20th of all (document, shingle) pairs, at least 1. So fewer than 2^20 shingles weigh
   less than 2, however large the corpus, and a weight depends on the share of documents only, not
   on the size of the input. A one-row Count-Min table of 2^22 counters tells which shingles may be
   that frequent (it never underestimates); these are counted exactly, combined in the map tasks.
2. Improved consistent weighted sampling (ICWS): 64 samples a text, in 16 bands of 4. Two texts of
   similarity 0.8 meet in a band with probability 0.9998, of 0.9 almost surely.
3. Rows with equal texts become one node. In every bucket of a band one member leads (another in
   every band): the others are compared with it, exactly, by weighted Jaccard, and links become
   classes by connected components. This costs a bucket rows, never pairs, and joins most copies.
4. Buckets that still hold several classes are compared in full, again by weighted Jaccard: all
   members outside of a bucket's largest class with all its members, in blocks of bounded size, one
   pair of blocks a task. A block pair returns at most one link for each class it joins on, so pairs
   are never rows. Buckets of the same members are compared once.

So every two texts that share a bucket end in one class if they are alike; no bucket is too large.

Cases: a null text counts as empty. Texts without words are alike only if identical. Rows that repeat
text and id are copies like others. Of a class the row with the least ``doc_id`` stays (nulls last).
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.bloom import blocks_for, member_filter, with_membership
from equipoise.llm.common import boxed, stored, text_or_empty
from equipoise.llm.components import components
from equipoise.llm.encoding import slices
from equipoise.llm.words import counted, mix, shingles, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20  # of texts that are compared with another block at once
SKETCH_BITS = 22
FREQUENT = 1 << 20  # shingles whose weight is below the highest
_ENTRY = np.dtype([("shingle", "<u8"), ("idf", "<f8")])
_HELD = 1 << 21
_CHUNKS = 64
_SEED = 0x5DEECE66D
_COLUMNS = 1024  # of the matrices of a block
_AT_ONCE = 1 << 15  # shingles that are sampled together


def text_node(text: Column) -> Column:
    """Equal texts are one node: half of their SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingle, text, count)`` in the order of texts."""
    return counted(*shingles(*word_hashes(texts), SHINGLE))


def _sketch(docs: DataFrame) -> np.ndarray:
    """One-row Count-Min counters of the document frequencies of all shingles."""
    width = 1 << SKETCH_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width, np.uint32)
        for big in batches:
            for batch in slices(big, 0):
                kinds, _, _ = weighted_shingles(batch.column(0))
                np.add.at(sketch, (kinds & np.uint64(width - 1)).astype(np.int64), np.uint32(1))
        if sketch.any():
            yield _chunks(sketch.reshape(_CHUNKS, -1), range(_CHUNKS))

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(data), np.uint64)
                sums[chunk] = sums[chunk] + more if chunk in sums else more
        if sums:
            yield _chunks(list(sums.values()), list(sums))

    def _chunks(parts, names) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.int32()), pa.array([zlib.compress(np.asarray(p, np.uint64).tobytes(), 1) for p in parts], pa.binary())], ["chunk", "data"]
        )

    schema = "chunk int, data binary"
    partial = docs.select(text_or_empty().alias("text")).mapInArrow(count, schema)
    # Two levels of sums, so that no task adds up the sketches of all map tasks.
    partial = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (["chunk", "salt"], ["chunk"]):
        partial = partial.repartition(*keys).select("chunk", "data").mapInArrow(add_up, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    counters = np.zeros((_CHUNKS, width // _CHUNKS), np.uint64)
    for chunk, data, _ in partial.collect():  # 2^22 counters, whatever the corpus
        counters[chunk] = np.frombuffer(zlib.decompress(data), np.uint64)
    return counters.ravel()


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> bytes:
    """Shingles of more than R documents and their weights, as rows of ``_ENTRY`` by shingle.

    R is the ``most``-th part of all pairs of a document and one of its shingles, so there are fewer
    than ``most`` such shingles, and R grows with the corpus as their frequencies do.
    """
    counters = _sketch(docs)
    rare = max(1.0, float(counters.sum()) / most)
    mask = np.uint64(len(counters) - 1)
    # Counters never underestimate: whatever is frequent has one above R.
    shared = docs.sparkSession.sparkContext.broadcast((counters > rare).tobytes())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, held, size = np.frombuffer(shared.value, bool), [], 0
        for big in batches:
            for batch in slices(big, 0):
                kinds, _, _ = weighted_shingles(batch.column(0))
                held.append(kinds[maybe[(kinds & mask).astype(np.int64)]])
                size += len(held[-1])
                if size >= _HELD:
                    yield _counts(held)
                    held, size = [], 0
        if size:
            yield _counts(held)

    def _counts(held: list) -> pa.RecordBatch:
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "shingle bigint, n bigint")
    # Fewer than ``most`` rows.
    found = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(rare)).orderBy("shingle").toArrow()
    shared.unpersist()
    table = np.empty(len(found), _ENTRY)
    table["shingle"] = found["shingle"].to_numpy()
    documents = docs.count()
    if len(found):
        table["idf"] = 1.0 + np.log(documents / found["n"].to_numpy()) / np.log(documents / rare)
    return table.tobytes()


class Weights:
    """TF-IDF weights from the broadcast table of frequent shingles; all others weigh 2."""

    def __init__(self, frequent: bytes):
        table = np.frombuffer(frequent, _ENTRY)
        self._kinds, self._idf = table["shingle"].copy(), table["idf"].copy()
        self._mask = np.uint64((1 << SKETCH_BITS) - 1)
        self._maybe = np.zeros(1 << SKETCH_BITS, bool)
        self._maybe[(self._kinds & self._mask).astype(np.int64)] = True

    def __call__(self, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(kinds), 2.0)
        some = np.flatnonzero(self._maybe[(kinds & self._mask).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self._kinds, kinds[some]), len(self._kinds) - 1)
            same = self._kinds[at] == kinds[some]
            idf[some[same]] = self._idf[at[same]]
        return counts * idf


class Sampler:
    """ICWS. The random numbers of a (shingle, sample) are cut from one hash: 16 bits each choose a
    quantile of Gamma(2, 1), of its logarithm, and of the uniform distribution."""

    def __init__(self, samples: int):
        x = np.linspace(0, 40, 400_001)
        steps = (np.arange(1 << 16) + 0.5) / (1 << 16)
        gamma = np.interp(steps, 1 - np.exp(-x) * (1 + x), x)
        self._rate = gamma.astype(np.float32)
        self._inverse = (1 / gamma).astype(np.float32)
        self._log = np.log(gamma).astype(np.float32)
        self._uniform = steps.astype(np.float32)
        rng = np.random.default_rng(_SEED)
        self._seeds = rng.integers(1 << 62, size=samples, dtype=np.uint64)

    def __call__(self, kinds: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Fingerprints ``[samples, texts]``; texts begin at ``starts`` and are not empty."""
        logs = np.log(weights).astype(np.float32)
        out = np.empty((len(self._seeds), len(starts)), np.uint32)
        ends = np.append(starts[1:], len(kinds))
        first = 0
        while first < len(starts):  # whole texts at a time, few enough that their arrays stay in the cache
            begin = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + _AT_ONCE, "right")))
            here = slice(begin, ends[last - 1])
            self._fill(kinds[here], logs[here], starts[first:last] - begin, out[:, first:last])
            first = last
        return out

    def _fill(self, kinds: np.ndarray, logs: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
        pair = np.empty((len(kinds), 2), "<u4")  # (mark, score) reads as one number that orders by score
        whole = pair.view("<u8")[:, 0]
        for i, seed in enumerate(self._seeds):
            bits = mix(kinds ^ seed)
            a, b, c = (bits.view("<u2").reshape(-1, 4)[:, k].astype(np.intp) for k in range(3))
            shift = self._uniform.take(c, mode="clip")
            t = logs * self._inverse.take(a, mode="clip")
            t += shift
            np.floor(t, out=t)
            # The score log(b) - rate * (t - shift + 1), in place.
            shift -= t
            shift -= np.float32(1)
            shift *= self._rate.take(a, mode="clip")
            shift += self._log.take(b, mode="clip")
            flip = (shift.view(np.int32) >> np.int32(31)).view(np.uint32)
            flip |= np.uint32(1 << 31)
            np.bitwise_xor(shift.view(np.uint32), flip, out=pair[:, 1])
            mark = t.astype(np.int32).view(np.uint32)
            mark *= np.uint32(0x9E3779B1)
            np.bitwise_xor(bits.astype(np.uint32), mark, out=pair[:, 0])
            out[i] = np.minimum.reduceat(whole, starts).astype(np.uint32)


def signatures(docs: DataFrame, frequent: bytes) -> DataFrame:
    """``doc_id, node, bands`` of every row; a text without words has no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(shared.value), Sampler(BANDS * ROWS)
        for big in batches:
            for batch in slices(big, 2):
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    kinds, rows, counts = weighted_shingles(part.column(2))
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(rows) > 0))) if len(rows) else np.empty(0, np.int64)
                    bands: list = [None] * len(part)
                    if len(starts):
                        marks = sampler(kinds, weights(kinds, counts), starts).astype(np.uint64)
                        keys = np.empty((BANDS, len(starts)), np.uint64)
                        for band in range(BANDS):
                            key = np.full(len(starts), band + 1, np.uint64)
                            for row in range(ROWS):
                                key = mix(key) ^ marks[band * ROWS + row]
                            keys[band] = mix(key)
                        for row, own in zip(rows[starts].tolist(), keys.view(np.int64).T.tolist()):
                            bands[row] = own
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_node(text_or_empty()).alias("node"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, node binary, bands array<bigint>")


def similarities(pairs: DataFrame, texts: DataFrame, frequent: bytes) -> DataFrame:
    """``(node, leader, similarity)`` by weighted Jaccard of the pairs' texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(frequent)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for big in batches:
            for batch in slices(big, 2):
                (a, row_a, n_a), (b, row_b, n_b) = weighted_shingles(batch.column(2)), weighted_shingles(batch.column(3))
                w_a, w_b = weights(a, n_a), weights(b, n_b)
                key_a, key_b = (r.astype(np.uint64) << np.uint64(44) | k for r, k in ((row_a, a), (row_b, b)))
                _, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
                n = len(batch)
                both = np.bincount(row_a[at_a], np.minimum(w_a[at_a], w_b[at_b]), n)
                either = np.bincount(row_a, w_a, n) + np.bincount(row_b, w_b, n) - both
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both / np.maximum(either, 1e-300), pa.float64())], ["node", "leader", "similarity"])

    left = texts.select(F.col("node"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("leader"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "node").join(right, "leader").select("node", "leader", "text_a", "text_b")
    return rows.mapInArrow(compare, "node binary, leader binary, similarity double")


def _candidate_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)`` of the given nodes; other texts are not shuffled."""
    blocks = blocks_for(nodes.count())
    wanted = stored(member_filter(nodes.select(F.xxhash64("node").alias("key")), blocks), "bloom")
    rows = docs.select(text_or_empty().alias("text")).select("text", text_node(F.col("text")).alias("node"))
    rows = with_membership(rows.withColumn("key", F.xxhash64("node")), wanted, blocks, "maybe").where("maybe")
    # One text per node, combined in the map tasks.
    return rows.groupBy("node").agg(F.first("text").alias("text")).withColumn("bytes", F.octet_length("text"))


def _roots_of(links: DataFrame) -> DataFrame:
    return stored(components(links.select(F.col("node").alias("a"), F.col("leader").alias("b"))), "roots")


def _features(texts: pa.Array, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(feature, text, weight)``. The n-th occurrence of a shingle is a feature of its own, so what
    two texts have in common weighs as much as their common features."""
    parts, at = [], 0
    for batch in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
        kinds, rows, counts = weighted_shingles(batch.column(0))
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        names = mix(np.repeat(kinds, counts) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((names, np.repeat(rows + at, counts), np.repeat(weights(kinds, np.ones(len(kinds))), counts)))
        at += len(batch)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_similarities(left: pa.Array, right: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard of every left with every right text, ``[left, right]``."""
    sides = [(*_features(texts, weights), len(texts)) for texts in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    totals, held = [], []
    for names, rows, weight, n in sides:
        totals.append(np.bincount(rows, weight, n))
        order = np.argsort(names, kind="stable")
        order = order[np.isin(names[order], common)]
        held.append((np.searchsorted(common, names[order]), rows[order], weight[order], n))
    both = np.zeros((len(left), len(right)))
    for at in range(0, len(common), _COLUMNS):
        dense = []
        for k, (column, rows, weight, n) in enumerate(held):
            a, b = np.searchsorted(column, (at, at + _COLUMNS))
            part = np.zeros((n, _COLUMNS))
            part[rows[a:b], column[a:b] - at] = 1.0 if k else weight[a:b]
            dense.append(part)
        both += dense[0] @ dense[1].T
    return both / np.maximum(totals[0][:, None] + totals[1][None, :] - both, 1e-300)


def _joining(pairs: np.ndarray, classes: np.ndarray) -> list[int]:
    """Which of the pairs join two classes that no earlier pair has joined."""
    parent = list(range(int(classes.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(classes[pairs].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _links_in_blocks(rows: DataFrame, texts: DataFrame, frequent: bytes, block_rows: int) -> DataFrame:
    """Links ``(node, leader)`` that join the classes of every bucket; ``rows`` is (key, node, root)."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    rows = stored(rows.join(texts.select("node", "bytes"), "node"), "open")
    # Per bucket: its size, its largest class, and a name of its set of members.
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    classes = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"))
    buckets = classes.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.max(F.struct("n", "root", "bytes")).alias("top")
    )

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / block_rows), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    cut = buckets.where("top.n < n").select(
        "key", "n", "one", "two", F.col("top.root").alias("top"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rest_blocks")
    )
    cut = cut.groupBy("n", "one", "two").agg(F.min(F.struct("key", "top", "blocks", "rest_blocks")).alias("cut")).select("cut.*")
    placed = stored(rows.join(cut, "key"), "placed")
    whole = placed.select("key", "node", "root", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), F.pmod(one, F.col("blocks")).cast("int").alias("j"))
    rest = placed.where("root <> top").select(
        "key", "node", "root", F.lit(True).alias("rest"), F.pmod(one, F.col("rest_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rest = group["rest"].to_numpy().astype(bool)
        left, right = np.flatnonzero(rest), np.flatnonzero(~rest)
        links = pa.table({"node": pa.array([], pa.binary()), "leader": pa.array([], pa.binary())})
        if not len(left) or not len(right):
            return links
        text = group["text"].combine_chunks()
        alike = _block_similarities(text.take(pa.array(left)), text.take(pa.array(right)), Weights(shared.value)) >= THRESHOLD - 1e-9
        roots = np.unique(np.array(group["root"].to_pylist(), object), return_inverse=True)[1]
        alike &= roots[left][:, None] != roots[right][None, :]
        a, b = np.nonzero(alike)
        pairs = np.stack((left[a], right[b]), 1)
        if not len(pairs):
            return links
        pairs = pairs[_joining(pairs, roots)]
        node = group["node"].combine_chunks()
        return pa.table({"node": node.take(pa.array(pairs[:, 0])).cast(pa.binary()), "leader": node.take(pa.array(pairs[:, 1])).cast(pa.binary())})

    sides = whole.unionByName(rest).join(texts.select("node", "text"), "node")
    found = sides.groupBy("key", "i", "j").applyInArrow(compare, "node binary, leader binary")
    return found.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()


def alike(docs: DataFrame, signed: DataFrame, frequent: bytes, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Links ``(node, leader)`` of similarity 0.8 or more between different texts, enough to join
    every class, and the classes ``(node, root)``."""
    nodes = signed.where("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    rows = stored(rows.join(shared, "key").select("key", "node"), "buckets")
    texts = stored(_candidate_texts(docs, rows.select("node").distinct()), "texts")
    # One member leads every bucket, another in every band.
    first = F.min(F.struct(F.xxhash64("node", "key").alias("draw"), "node"))
    leaders = stored(rows.groupBy("key").agg(first.alias("best")).select("key", F.col("best.node").alias("leader")), "leaders")
    met = rows.join(leaders, "key").where("node <> leader")
    pairs = met.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
    links = stored(similarities(pairs, texts, frequent).where(F.col("similarity") >= THRESHOLD - 1e-9).select("node", "leader"), "links")
    roots = _roots_of(links)
    # A leader has met its whole bucket and leaves; a bucket that is one class is done.
    rest = rows.join(leaders.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti")
    rest = stored(rest.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rest")
    open_ = rest.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("key")
    more = stored(_links_in_blocks(rest.join(open_, "key"), texts, frequent, block_rows), "links")
    links = links.unionByName(more).distinct()
    return links, _roots_of(links)


def _classes(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows ``(doc_id, node)``, links, and ``(node, root)`` of linked nodes."""
    frequent = frequent_shingles(docs)
    signed = stored(signatures(docs, frequent), "signed")
    links, roots = alike(docs, signed, frequent, block_rows)
    return signed.select("doc_id", "node"), links, roots


def near_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the least id of its class), ``class_size``,
    ``n_links`` (links by which its text was joined; members of one class are not all compared) and
    ``kept``."""
    rows, links, roots = _classes(docs, block_rows)
    ends = links.select("node").unionByName(links.select(F.col("leader").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = stored(roots.join(ends, "node"), "nodes")
    # Copies are counted per id first; adaptive execution splits the partition of a hot text.
    rows = rows.join(nodes, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    rows = stored(rows, "rows")
    classes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    many = stored(classes.where("class_size > 1"), "classes")
    out = rows.join(many, "root", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"), "n_links"
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns; rows that are alone pass without a shuffle."""
    rows, _, roots = _classes(docs)
    copied = rows.groupBy("node").count().where("count > 1").select("node")
    grouped = stored(copied.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")).unionByName(roots), "grouped")
    blocks = blocks_for(grouped.count())
    filter_ = stored(member_filter(grouped.select(F.xxhash64("node").alias("key")), blocks), "bloom")
    node = text_node(text_or_empty())
    flagged = with_membership(boxed(docs, node=node, key=F.xxhash64(node)), filter_, blocks, "maybe")
    names = [c for c, kind in docs.dtypes if c != "text" and "map" not in kind and "variant" not in kind]
    order = F.struct(F.col("row.doc_id").isNull(), *[F.col("row").getField(c) for c in ["doc_id", *[n for n in names if n != "doc_id"]]])
    # Copies of one text are combined in the map tasks, then the texts of a class.
    one = flagged.where("maybe").groupBy("node").agg(F.min_by("row", order).alias("row"))
    one = one.join(grouped, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min_by("row", order).alias("row"))
    return flagged.where("not maybe").select("row").unionByName(one.select("row")).select("row.*")
