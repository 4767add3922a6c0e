"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are counted by membership pattern (the set of
their sources), so the flow network has a node per pattern and per source, not per document. A
pattern offers its words once at cost 1, a second time at cost 2, and so on: costs are convex, so
repeats are used only where fresh words cannot meet a quota. Each pattern's flow is then turned into
whole documents: all of them as often as the flow allows, and the rest in seeded order. A document
that exceeds what is left is taken at once if it is larger than all before it, else it is passed by;
this goes on until no document fits, so the words left are fewer than any document not taken has.

Only sums per pattern reach the driver, at most ``MAX_PATTERNS`` of them (more raise an error). A
prefix is found by a histogram of 65,536 hash ranges per pattern, counted before the shuffle, then
inside the one range where it ends: no pattern is sorted as a whole, however hot it is. Each search
halves what is left or passes by a group of repeated rows that is too large together, so their number
is at most the logarithm of the words and the count of such groups.

Cases: a null text has no words, a null source is a source of its own and sorts last. Rows that
repeat id and text share one fate. An empty table gives an empty result, a source without words the
target 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipoise.llm.common import stored, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
MAX_PATTERNS = 100_000
BIN_SHIFT = 47  # 63 hash bits: 2^16 ranges

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``cap`` times a size goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def route(patterns: Mapping[tuple, int], quotas: Mapping[object, int], max_copies: int) -> dict[tuple, dict[object, int]]:
    """Min-cost flow of words from patterns to source quotas, ``{pattern: {source: words}}``.

    The k-th use of a word costs k, whatever its source, so successive shortest paths are maximum
    flows under a capacity that grows by one copy per phase; earlier flow may be rerouted. Each is
    found by blocking flows over breadth-first levels: one round where no source is shared. Ties are
    broken by the order of patterns, whatever the order they come in.
    """
    names = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    sources = sorted({s for p in names for s in p}, key=lambda s: (s is None, s or ""))
    first = len(names)
    number = {s: first + i for i, s in enumerate(sources)}
    arcs: list[list[int]] = [[number[s] for s in p] for p in names] + [[] for _ in sources]
    for i in range(first):
        for j in arcs[i]:
            arcs[j].append(i)
    flow = [dict.fromkeys(arcs[i], 0) for i in range(first)]
    room = [quotas.get(s, 0) for s in sources]
    spare = [0] * first
    for _ in range(max_copies):
        spare = [left + patterns[p] for left, p in zip(spare, names)]
        while goal := _levels(arcs, flow, spare, room):
            _block(arcs, flow, spare, room, *goal)
    return {p: {sources[j - first]: n for j, n in flow[i].items()} for i, p in enumerate(names)}


def _levels(arcs: list[list[int]], flow: list[dict[int, int]], spare: list[int], room: list[int]) -> tuple[list[int], int] | None:
    """Steps from a pattern with words left to every node, and to the nearest source with room."""
    first = len(flow)
    level = [0 if left > 0 else -1 for left in spare] + [-1] * len(room)
    queue = deque(i for i in range(first) if level[i] == 0)
    while queue:
        node = queue.popleft()
        if node >= first and room[node - first] > 0:
            return level, level[node]
        for other in arcs[node]:
            if level[other] < 0 and (node < first or flow[other][node] > 0):
                level[other] = level[node] + 1
                queue.append(other)
    return None


def _block(arcs: list[list[int]], flow: list[dict[int, int]], spare: list[int], room: list[int], level: list[int], goal: int) -> None:
    """Send words along shortest paths until each of them is blocked."""
    first, tried = len(flow), [0] * len(arcs)
    for start in range(first):
        path = [start] if level[start] == 0 else []
        while path and spare[start] > 0:
            node = path[-1]
            if level[node] == goal and node >= first and room[node - first] > 0:
                back = [(p, s) for s, p in zip(path[1::2], path[2::2])]
                words = min(spare[start], room[node - first], *[flow[p][s] for p, s in back])
                for p, s in zip(path[::2], path[1::2]):
                    flow[p][s] += words
                for p, s in back:
                    flow[p][s] -= words
                spare[start] -= words
                room[node - first] -= words
                path = [start]
                continue
            while level[node] < goal and tried[node] < len(arcs[node]):
                other = arcs[node][tried[node]]
                if level[other] == level[node] + 1 and (node < first or flow[other][node] > 0):
                    path.append(other)
                    break
                tried[node] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def items_of(docs: DataFrame, sources: Column, seed: int) -> DataFrame:
    """``(doc_id, pattern, size, spot)``: sorted sources, words, and the place in seeded order."""
    text = text_or_empty()
    spot = F.xxhash64(F.lit(seed), F.col("doc_id"), text).bitwiseAND(F.lit((1 << 63) - 1))
    pattern = F.array_sort(F.array_distinct(sources))
    return docs.select(F.col("doc_id"), pattern.alias("pattern"), word_count(text).alias("size"), spot.alias("spot"))


def _pattern_key(pattern: Column) -> Column:
    """Patterns hold nulls, which a join would not match."""
    return F.to_json(F.struct(pattern.alias("p")), {"ignoreNullFields": "false"})


def _fitting(items: DataFrame, left: DataFrame) -> DataFrame:
    """Documents behind ``after`` that are not taken and not larger than ``rest``."""
    rows = items.join(F.broadcast(left), "key")
    return rows.where((F.col("spot") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~F.array_contains("extra", F.col("spot")))


def _ranges(items: DataFrame, left: DataFrame) -> DataFrame:
    """``(key, words, cut)``: words of all that fit, and the hash range where they exceed ``rest``."""
    ranges = _fitting(items, left).groupBy("key", F.shiftright("spot", BIN_SHIFT).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("key").orderBy("bin")
    # At most 65,536 rows per pattern.
    ranges = ranges.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    over = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    return ranges.groupBy("key").agg(F.sum("words").alias("words"), F.max(F.when(over, F.struct("bin", "before"))).alias("cut"))


def _ends(items: DataFrame, left: DataFrame) -> DataFrame:
    """``(key, last, used, next)``: the prefix's end in its range, its words, and what follows it."""
    inside = _fitting(items, left).where(F.shiftright("spot", BIN_SHIFT) == F.col("bin"))
    inside = inside.groupBy("key", "before", "rest", "spot").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("end", F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("spot")))
    fits = F.col("end") <= F.col("rest")
    return inside.groupBy("key").agg(
        F.max(F.when(fits, F.col("spot"))).alias("last"), F.max(F.when(fits, F.col("end"))).alias("used"), F.min(F.when(~fits, F.struct("spot", "words"))).alias("next")
    )


def choose(items: DataFrame, flow: Mapping[str, tuple[int, int]]) -> DataFrame:
    """How often each document of a pattern is taken: ``(key, copies, spans, extra)``.

    ``flow`` maps a pattern to its words and to the words the mix takes from it. A document is taken
    ``copies`` times, and once more if its spot is among ``extra`` or in one of ``spans``: behind
    ``after``, up to ``last``, for documents of at most ``most`` words.
    """
    spark = items.sparkSession
    plan = {k: (taken // words if words else 0, [], []) for k, (words, taken) in flow.items()}
    gaps = {k: taken - words * (taken // words) for k, (words, taken) in flow.items() if words}
    after = dict.fromkeys(gaps, -1)
    state = "key string, rest bigint, after bigint, extra array<bigint>"
    while gaps := {k: rest for k, rest in gaps.items() if rest}:
        left = [(k, rest, after[k], plan[k][2]) for k, rest in gaps.items()]
        found = {k: (words, cut) for k, words, cut in _ranges(items, spark.createDataFrame(left, state)).collect()}
        cuts = [(*row, *found[row[0]][1]) for row in left if row[0] in found and found[row[0]][1]]
        ends = {}
        if cuts:
            ends = {row[0]: row[1:] for row in _ends(items, spark.createDataFrame(cuts, state + ", bin bigint, before bigint")).collect()}
        for k, rest, start, extra in left:
            words, cut = found.get(k, (0, None))
            if not cut:  # all that fit, or none
                plan[k][1].append((start, (1 << 63) - 1, rest))
                gaps[k] = 0
                continue
            last, used, (spot, more) = ends[k]
            last = max(start, (cut.bin << BIN_SHIFT) - 1) if last is None else last
            used = cut.before if used is None else used
            if used < more <= rest:
                extra.append(spot)
                gaps[k] -= more
            else:
                plan[k][1].append((start, last, rest))
                gaps[k] -= used
                after[k] = spot
    schema = "key string, copies bigint, spans array<struct<after:bigint,last:bigint,most:bigint>>, extra array<bigint>"
    return spark.createDataFrame([(k, *row) for k, row in plan.items()], schema)


def copies_of() -> Column:
    """Times a document is taken, given its size and spot and the columns of ``choose``."""
    spot, size = F.col("spot"), F.col("size")
    more = F.exists("spans", lambda s: (spot > s["after"]) & (spot <= s["last"]) & (size <= s["most"])) | F.array_contains("extra", spot)
    return F.col("copies") + F.when(more, 1).otherwise(0)


def mixed(docs: DataFrame, sources: Column, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES, seed: int = 17) -> tuple[DataFrame, DataFrame, dict]:
    """Items of the documents, the choice per pattern, and ``{source: (words, target)}``."""
    items = items_of(docs, sources, seed).withColumn("key", _pattern_key(F.col("pattern")))
    items = stored(items, "mix")
    sums = items.groupBy("key", "pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    keys = {tuple(row.pattern or ()): row.key for row in sums}
    words = {tuple(row.pattern or ()): int(row.words) for row in sums}
    names = sorted({s for p in words for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for p, w in words.items() if s in p) for s in names]
    total = sum(words.values())
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total, max_copies)
    routed = route(words, {s: round(t) for s, t in zip(names, targets)}, max_copies)
    choice = choose(items, {keys[p]: (words[p], sum(routed[p].values())) for p in words})
    return items, choice, {s: (size, target) for s, size, target in zip(names, sizes, targets)}


def mix_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of documents with one source each."""
    items, choice, sources = mixed(docs, F.array("source"))
    facts = spark.createDataFrame([(s, size, target) for s, (size, target) in sources.items()], "source string, source_size bigint, target double")
    facts = facts.withColumn("key", _pattern_key(F.array("source"))).drop("source")
    # Bounded: a row per source, at most MAX_PATTERNS.
    rows = items.join(F.broadcast(facts), "key").join(F.broadcast(choice), "key")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of()).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    _, choice, _ = mixed(docs, F.array("source"), seed=seed)
    text = text_or_empty()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    spot = F.xxhash64(F.lit(seed), F.col("doc_id"), text).bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs.select(row.alias("row"), _pattern_key(F.array_sort(F.array_distinct(F.array("source")))).alias("key"), word_count(text).alias("size"), spot.alias("spot"))
    rows = rows.join(F.broadcast(choice), "key").select("row", copies_of().cast("int").alias("times")).where("times > 0")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
