"""Token ids in binary blocks, compressed by Re-Pair grammars.

Documents are dealt by ranges of ``doc_id``, so blocks follow one another in id order. A block holds
whole documents. Re-Pair replaces frequent pairs of ids by nonterminals, round by round: each round
counts all pairs, turns the most frequent ones into rules and replaces their occurrences from left
to right, until no pair occurs ``MIN_PAIRS`` times in the block or the 16-bit symbols are used up. Beside the symbols a
block stores its rules, the expansion length of every symbol, and the documents' lengths, so any
range of ids can be decoded without the rest of the block.

The file format is a Parquet table of blocks with the columns of ``BLOCK``; Spark's committer makes
the writing safe against lost executors and retried tasks.

Cases: a null text counts as empty; an empty text is the end id alone. Null ids come first. Rows
that repeat an id follow one another in the order of their texts' hashes. An empty table gives no
blocks and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipoise.llm.common import stored, text_or_empty
from equipoise.llm.encoding import WordEncoder, WIDE_BYTES, public_path, slices

VOCABULARY = "word_bpe_49k.json"
TERMINALS = 49_408
END_ID = 1
BLOCK_IDS = 1 << 20
PART_ROWS = 16_000
RULES_A_ROUND = 1024
MIN_PAIRS = 16
MAX_BROADCAST_BLOCKS = 2_000_000

BLOCK = (
    "part int, block int, n_ids bigint, n_docs bigint, doc_ids binary, doc_nulls binary, doc_lengths binary, "
    "rules binary, expansion binary, symbols binary, checkpoints binary"
)
STEP = 256  # every so many symbols a checkpoint notes the ids before them


def _places(kinds: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair stands in the sorted ``kinds``, and whether it does: by a table of hashes, and by
    search for the few kinds that meet in one slot."""
    hashed = lambda v: (v * np.uint32(2_654_435_761)) >> np.uint32(12)
    own, asked = hashed(kinds), hashed(pairs)
    table = np.zeros(1 << 20, np.int32)
    table[own] = np.arange(len(kinds), dtype=np.int32)
    at = table[asked]
    found = kinds[at] == pairs
    lost = own[table[own] != np.arange(len(kinds))]
    if len(lost):
        shared = np.zeros(1 << 20, bool)
        shared[lost] = True
        again = np.flatnonzero(~found & shared[asked])
        at[again] = np.minimum(np.searchsorted(kinds, pairs[again]), len(kinds) - 1)
        found[again] = kinds[at[again]] == pairs[again]
    return at, found


def compress(ids: np.ndarray, terminals: int = TERMINALS, rules_a_round: int = RULES_A_ROUND, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, rules)``: rule k stands for symbol ``terminals + k`` and names two symbols.

    A pair of old symbols never becomes more frequent. So places whose pair was too rare in one round
    are not counted in later ones, unless a new symbol comes next to them.
    """
    symbols = ids.astype(np.uint32)
    live = np.arange(max(0, len(symbols) - 1))  # places whose pair may still be frequent
    rules: list[np.ndarray] = []
    made = 0
    room = (1 << 16) - terminals
    while len(live) and made < room:
        pairs = (symbols[live] << np.uint32(16)) | symbols[live + 1]
        ordered = np.sort(pairs)
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= min_pairs)
        if not len(often):
            break
        kinds, counts = ordered[edges[:-1]][often], counts[often]
        best = np.lexsort((kinds, -counts))[: min(rules_a_round, room - made)]
        number = np.full(len(kinds), -1)
        number[np.sort(best)] = np.arange(len(best))  # rules of a round are in the order of their pairs
        at, frequent = _places(kinds, pairs)
        live, at = live[frequent], at[frequent]
        hit = number[at] >= 0
        where, rule = live[hit], number[at[hit]]
        # In a run of overlapping occurrences every second one is replaced, from the left.
        starts = np.concatenate(([True], np.diff(where) > 1)) if len(where) else np.empty(0, bool)
        run = np.maximum.accumulate(np.where(starts, np.arange(len(where)), 0))
        take = (np.arange(len(where)) - run) % 2 == 0
        where, rule = where[take], rule[take]
        symbols[where] = (terminals + made + rule).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        open_ = np.zeros(len(symbols), bool)
        open_[live] = True
        open_[where] = True
        before = where - 1  # the place before a new symbol is one or two to the left
        before = np.where((before >= 0) & ~keep[before], before - 1, before)
        open_[before[before >= 0]] = True
        symbols, open_ = symbols[keep], open_[keep]
        live = np.flatnonzero(open_[:-1])
        chosen = kinds[np.sort(best)]
        rules.append(np.stack((chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)), axis=1).astype(np.uint16))
        made += len(best)
    return symbols.astype(np.uint16), np.concatenate(rules) if rules else np.empty((0, 2), np.uint16)


def expansions(rules: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """Ids that each nonterminal stands for; rules name earlier symbols only."""
    sizes = np.ones(len(rules), np.uint32)
    get = lambda s, done: np.where(s < terminals, 1, done[np.maximum(s.astype(np.int64) - terminals, 0)])
    level = -1
    while level != (level := int(sizes.sum())):
        if len(rules):
            sizes = (get(rules[:, 0], sizes) + get(rules[:, 1], sizes)).astype(np.uint32)
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """The ids behind symbols."""
    out = symbols.astype(np.uint32)
    while len(out) and int(out.max()) >= terminals:
        inner = out >= terminals
        ends = np.cumsum(np.where(inner, 2, 1))
        wide = np.empty(int(ends[-1]), np.uint32)
        wide[ends[~inner] - 1] = out[~inner]
        pair = rules[out[inner] - terminals]
        wide[ends[inner] - 2] = pair[:, 0]
        wide[ends[inner] - 1] = pair[:, 1]
        out = wide
    return out


def decode_range(block: dict, start: int, length: int, terminals: int = TERMINALS) -> np.ndarray:
    """``length`` ids from id ``start`` of a block on, decoding only the symbols that cover them."""
    symbols = np.frombuffer(block["symbols"], "<u2")
    rules = np.frombuffer(block["rules"], "<u2").reshape(-1, 2)
    sizes = np.frombuffer(block["expansion"], "<u4")
    marks = np.frombuffer(block["checkpoints"], "<u8")
    if length <= 0 or not len(symbols):
        return np.empty(0, np.uint32)
    first = max(0, int(np.searchsorted(marks, start, side="right")) - 1)
    last = int(np.searchsorted(marks, start + length, side="left"))
    part = symbols[first * STEP : max(first + 1, last) * STEP].astype(np.int64)
    widths = np.where(part < terminals, 1, sizes[np.maximum(part - terminals, 0)] if len(sizes) else 1).astype(np.int64)
    ends = np.cumsum(widths) + int(marks[first])
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, start + length, side="left")) + 1
    ids = expand(part[a:b], rules, terminals)
    skip = start - int(ends[a] - widths[a])
    return ids[skip : skip + length]


def _block_row(part: int, number: int, docs: list[tuple], bodies: list[np.ndarray]) -> dict:
    ids = np.concatenate(bodies)
    symbols, rules = compress(ids)
    sizes = expansions(rules)
    wide = symbols.astype(np.int64)
    widths = np.where(wide < TERMINALS, 1, sizes[np.maximum(wide - TERMINALS, 0)] if len(sizes) else 1).astype(np.uint64)
    marks = (np.cumsum(widths) - widths)[::STEP]
    return {
        "part": part,
        "block": number,
        "n_ids": len(ids),
        "n_docs": len(docs),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
        "doc_nulls": np.array([d is None for d in docs], "u1").tobytes(),
        "doc_lengths": np.array([len(b) for b in bodies], "<u8").tobytes(),
        "rules": rules.astype("<u2").tobytes(),
        "expansion": sizes.astype("<u4").tobytes(),
        "symbols": symbols.astype("<u2").tobytes(),
        "checkpoints": marks.astype("<u8").tobytes(),
    }


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in BLOCK.split(", "))])


def encode_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Blocks of the documents' ids, in the order of ``(part, block)``."""
    schema = _schema()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = None, 0
        part = TaskContext.get().partitionId()
        names: list = []
        bodies: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], np.uint32)
        for big in batches:
            for batch in slices(big, 1, 3 * WIDE_BYTES):
                encoder = encoder or WordEncoder(public_path(vocabulary))
                ids, offsets = encoder(batch.column(1))
                for i, name in enumerate(batch.column(0).to_pylist()):
                    names.append(name)
                    bodies.append(np.concatenate((ids[offsets[i] : offsets[i + 1]], end)))
                    held += len(bodies[-1])
                    if held >= BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist([_block_row(part, number, names, bodies)], schema)
                        names, bodies, held, number = [], [], 0, number + 1
        if names:
            yield pa.RecordBatch.from_pylist([_block_row(part, number, names, bodies)], schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = max(1, docs.count() // PART_ROWS)
    # Equal ids are spread by the hash behind them.
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return rows.select("doc_id", "text").mapInArrow(write, BLOCK)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Read blocks back: ``doc_id, start, n_tokens, ids_crc32`` of every document."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per part of some 16,000 documents.
    parts = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("part", "block", "n_ids").withColumn("inside", inside).join(parts, "part")
    starts = starts.select("part", "block", (F.col("inside") + F.col("part_start")).alias("before"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                ids = expand(np.frombuffer(block["symbols"], "<u2"), np.frombuffer(block["rules"], "<u2").reshape(-1, 2)).astype("<u4")
                lengths = np.frombuffer(block["doc_lengths"], "<u8").astype(np.int64)
                names = np.frombuffer(block["doc_ids"], "<i8")
                nulls = np.frombuffer(block["doc_nulls"], "u1").astype(bool)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=nulls), pa.array(block["before"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    used = blocks.select("part", "block", "doc_ids", "doc_nulls", "doc_lengths", "rules", "symbols")
    few = blocks.count() <= MAX_BROADCAST_BLOCKS  # 24 bytes each; more of them are joined by a shuffle
    return used.join(F.broadcast(starts) if few else starts, ["part", "block"]).mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the blocks and read every document back from the files."""
    return read_documents(stored(encode_blocks(docs, vocabulary, end_id), "ids"))
