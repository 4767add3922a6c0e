"""Count-Min and Count sketches as mergeable tables of counters.

A sketch is the table ``(d, col, counter)``; cells that no item hit are absent. It is linear:
the sketch of a union is the sum of the sketches, and a frequency table sketches like its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.hashing import HASH_PRIME, HashRow, SketchParams, bucket, row_struct, sign

# Kinds of rows in the combined state of a stream; the state is keyed by their position.
EXACT, COUNT_MIN, COUNT = KINDS = ("exact", "count_min", "count")


def _rows(params: SketchParams, signed: bool, first: int = 0) -> list[Column]:
    """Parameters of every row. A sketch is one line of counters, row after row, that begins at
    the cell ``first``."""
    return [
        row_struct(
            row,
            first=F.lit(first + d * params.width).cast("bigint"),
            width=F.lit(params.width),
            signed=F.lit(signed),
        )
        for d, row in enumerate(params.checked().rows)
    ]


def _cell(row: Column) -> Column:
    return bucket(F.col("item"), row, row["width"]) + row["first"]


def _sign(row: Column) -> Column:
    return F.when(row["signed"], sign(F.col("item"), row)).otherwise(1)


def _add_up(items: DataFrame, rows: list[Column], weight: str | None) -> DataFrame:
    """``(cell, counter)``; the shuffle moves at most one row per cell and map task.

    Rows are exploded as data. Hashes written out row by row would make code that the JIT
    refuses from about ten rows on.
    """
    amount = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    hit = items.select("item", amount.alias("amount"), F.explode(F.array(*rows)).alias("row"))
    row = F.col("row")
    deltas = hit.select(_cell(row).alias("cell"), (F.col("amount") * _sign(row)).alias("delta"))
    return deltas.groupBy("cell").agg(F.sum("delta").alias("counter"))


def _to_table(cells: DataFrame, params: SketchParams) -> DataFrame:
    return cells.select(
        F.floor(F.col("cell") / params.width).cast("int").alias("d"),
        (F.col("cell") % params.width).cast("int").alias("col"),
        "counter",
    )


def _to_cells(table: DataFrame, params: SketchParams, first: int = 0) -> DataFrame:
    return table.select((F.col("d").cast("bigint") * params.width + F.col("col") + first).alias("cell"), "counter")


def count_min_sketch(items: DataFrame, params: SketchParams, weight: str | None = None) -> DataFrame:
    """``(d, col, counter)``: every item adds one, or its weight, to one cell of every row.

    The shuffle moves at most depth * width counters per map task, whatever the input size.
    """
    return _to_table(_add_up(items, _rows(params, signed=False), weight), params)


def count_sketch(items: DataFrame, params: SketchParams, weight: str | None = None) -> DataFrame:
    """``(d, col, counter)``: as Count-Min, but each row's sign hash decides between + and -."""
    return _to_table(_add_up(items, _rows(params, signed=True), weight), params)


def sketch_pair(
    items: DataFrame, count_min: SketchParams, count: SketchParams, weight: str | None = None
) -> DataFrame:
    """Both sketches from one pass, as ``(cell, counter)``: first the Count-Min rows, then the
    Count sketch rows."""
    return _add_up(items, _pair_rows(count_min, count), weight)


def _pair_rows(count_min: SketchParams, count: SketchParams) -> list[Column]:
    return _rows(count_min, signed=False) + _rows(count, signed=True, first=count_min.cells)


def pair_of(
    count_min_table: DataFrame, count_table: DataFrame, count_min: SketchParams, count: SketchParams
) -> DataFrame:
    """``sketch_pair`` from two finished tables."""
    return _to_cells(count_min_table, count_min).unionByName(_to_cells(count_table, count, count_min.cells))


def sketch_updates(items: DataFrame, count_min: SketchParams, count: SketchParams) -> DataFrame:
    """``(kind, d, key, delta)``: what each item adds to the exact counts and to both sketches.

    Summing ``delta`` per ``(kind, d, key)`` gives all three from one pass. ``kind`` is the
    position in ``KINDS``, since the state is smaller and faster with fixed-width keys.
    """
    sketches = {EXACT: SketchParams((HashRow(1, 0),), 1), COUNT_MIN: count_min, COUNT: count}
    rows = [
        row_struct(row, kind=F.lit(KINDS.index(kind)), d=F.lit(d), width=F.lit(params.width))
        for kind, params in sketches.items()
        for d, row in enumerate(params.checked().rows)
    ]
    exploded = items.select(F.col("item").cast("int").alias("item"), F.explode(F.array(*rows)).alias("row"))
    item, row, kind = F.col("item"), F.col("row"), F.col("row.kind")
    return exploded.select(
        kind.alias("kind"),
        F.col("row.d").alias("d"),
        F.when(kind == KINDS.index(EXACT), item).otherwise(bucket(item, row, row["width"])).alias("key"),
        F.when(kind == KINDS.index(COUNT), sign(item, row)).otherwise(1).alias("delta"),
    )


def kind_name(kind: str = "kind") -> Column:
    """The name of a position in ``KINDS``."""
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col(kind) + 1)


def _slots(params: SketchParams) -> int:
    """Cells of a row that any item can hit: remainders lie between -8190 and 8190, so beyond
    16,381 columns a row's middle stays empty."""
    return min(params.width, 2 * HASH_PRIME - 1)


def _index_rows(params: SketchParams, signed: bool, first: int = 0) -> list[Column]:
    """Parameters of every row for reading: ``start`` is the row's first slot."""
    slots = _slots(params)
    return [
        row_struct(
            row,
            start=F.lit(first + d * slots),
            slots=F.lit(slots),
            signed=F.lit(signed),
        )
        for d, row in enumerate(params.checked().rows)
    ]


def _slot_cells(spark: SparkSession, params: SketchParams, first_cell: int = 0, first_slot: int = 0) -> DataFrame:
    """``(slot, cell)`` of every slot of a sketch whose line of counters begins at ``first_cell``."""
    slots, slot = _slots(params), F.col("id")
    row, place = F.floor(slot / slots), slot % slots
    col = F.when(place < HASH_PRIME, place).otherwise(place + (params.width - slots))
    ids = spark.range(params.depth * slots, numPartitions=1)
    return ids.select((slot + first_slot).alias("slot"), (row * params.width + col + first_cell).alias("cell"))


def _read_cells(freq: DataFrame, cells: DataFrame, slots: DataFrame, rows: list[Column]) -> DataFrame:
    """Add ``_read``: the signed counters that every item meets, in the order of the rows.

    The counters become one array that travels with the plan: at most 16,381 values a row of the
    sketch, whatever its width. Slots look up their cells: a condition on the cells would be pushed
    down to the hits of the items and written out there as code that the JIT refuses.
    """
    filled = slots.join(cells, "cell", "left").select(
        F.struct("slot", F.coalesce("counter", F.lit(0)).alias("counter")).alias("entry")
    )
    ordered = F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["counter"])
    dense = filled.agg(ordered.alias("counters")).scalar()

    def hit(row: Column) -> Column:
        # Slots wrap around as columns do: without the empty middle the remainders still fit.
        at = row["start"] + bucket(F.col("item"), row, row["slots"])
        return F.struct(at.alias("at"), _sign(row).alias("sign"))

    # The array is only referred to here; a column of it would be copied for every item.
    hits = [F.col("_hits")[d] for d in range(len(rows))]
    read = F.array(*[dense[h["at"]] * h["sign"] for h in hits])
    return freq.withColumn("_hits", F.transform(F.array(*rows), hit)).withColumn("_read", read).drop("_hits")


def _count_estimate(depth: int, rows: str) -> Column:
    """Median of the row estimates in a column; an even number averages the middle pair,
    truncated toward zero."""
    ranked = f"sort_array({rows})"
    half = depth // 2
    return F.expr(f"{ranked}[{half}]" if depth % 2 else f"({ranked}[{half - 1}] + {ranked}[{half}]) div 2")


def with_count_min_estimate(
    freq: DataFrame, sketch: DataFrame, params: SketchParams, name: str = "est"
) -> DataFrame:
    """Add the Count-Min estimate of every ``item``: its smallest counter, never below the truth."""
    slots = _slot_cells(freq.sparkSession, params)
    read = _read_cells(freq, _to_cells(sketch, params), slots, _index_rows(params, signed=False))
    return read.withColumn(name, F.array_min("_read")).drop("_read")


def with_count_sketch_estimate(
    freq: DataFrame, sketch: DataFrame, params: SketchParams, name: str = "est"
) -> DataFrame:
    """Add the Count sketch estimate of every ``item``: the median of its signed counters.

    With an even number of rows the two middle values are averaged, truncated toward zero.
    """
    slots = _slot_cells(freq.sparkSession, params)
    read = _read_cells(freq, _to_cells(sketch, params), slots, _index_rows(params, signed=True))
    return read.withColumn(name, _count_estimate(params.depth, "_read")).drop("_read")


def with_both_estimates(
    freq: DataFrame, pair: DataFrame, count_min: SketchParams, count: SketchParams
) -> DataFrame:
    """Add ``cm_est`` and ``cs_est`` of every ``item`` from a ``sketch_pair``."""
    first = count_min.depth * _slots(count_min)
    spark = freq.sparkSession
    slots = _slot_cells(spark, count_min).unionByName(_slot_cells(spark, count, count_min.cells, first))
    rows = _index_rows(count_min, signed=False) + _index_rows(count, signed=True, first=first)
    read = _read_cells(freq, pair, slots, rows)
    split = read.withColumn("_cm", F.slice("_read", 1, count_min.depth)).withColumn(
        "_cs", F.slice("_read", count_min.depth + 1, count.depth)
    )
    return (
        split.withColumn("cm_est", F.array_min("_cm"))
        .withColumn("cs_est", _count_estimate(count.depth, "_cs"))
        .drop("_read", "_cm", "_cs")
    )
