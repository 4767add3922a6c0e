from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from equipoise.operators.frequencies import item_frequencies
from equipoise.operators.sketches import count_min_sketch, count_sketch
from equipoise.plans.reports import stream_report
from equipoise.plans.views import COUNT_MIN_PARAMS as CM
from equipoise.plans.views import COUNT_PARAMS as CS
from equipoise.sources.replay import replay, stage_in_order, staged_files
from equipoise.sources.text import parse_items, stream_lines
from equipoise.streaming.bounded import batch_updates, count_min_of, count_of, count_prefix, frequencies_of, prefix_counters
from equipoise.streaming.counters import latest_counters, running_counters, start_counters
from equipoise.streaming.versions import CounterVersions

FILES, PER_FILE = 5, 200
SCHEMA = "seq bigint, item int"


def item_of(seq):
    return (seq * seq) % 17 * 104729 + 1_500_000_000


@pytest.fixture()
def files(spark, tmp_path):
    """Files that arrive one by one, each a stretch of the sequence."""
    folder = tmp_path / "items"
    for i in range(FILES):
        rows = [(s, item_of(s)) for s in range(i * PER_FILE, (i + 1) * PER_FILE)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, files):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def check_against_batch(spark, counters, batch):
    assert rows_of(frequencies_of(counters)) == rows_of(item_frequencies(batch))
    assert rows_of(count_min_of(counters)) == rows_of(count_min_sketch(batch, CM))
    assert rows_of(count_of(counters)) == rows_of(count_sketch(batch, CS))


def test_whole_stream_equals_batch(spark, files, tmp_path):
    out = str(tmp_path / "out")
    counters = running_counters(stream(spark, files), CM, CS)
    start_counters(counters, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/delta").select("batch_id").distinct().count() == FILES
    check_against_batch(spark, latest_counters(spark, out), spark.read.parquet(files))


@pytest.mark.parametrize("t", [1, 200, 450, 1000])
def test_exactly_t_items(spark, files, tmp_path, t):
    counters = count_prefix(
        stream(spark, files), t, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"),
        trigger={"availableNow": True}, order_by="seq",
    )
    seen = sum(r.freq for r in frequencies_of(counters).collect())
    assert seen == t
    for d, n in count_min_of(counters).groupBy("d").agg(F.sum("counter")).collect():
        assert n == t


def test_prefix_equals_batch_on_the_same_rows(spark, tmp_path):
    # One file, so that the order across files plays no role.
    folder = str(tmp_path / "items")
    rows = [(s, item_of(s)) for s in range(1000)]
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(folder)
    counters = count_prefix(
        stream(spark, folder), 450, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"),
        trigger={"availableNow": True}, order_by="seq",
    )
    prefix = spark.read.parquet(folder).where("seq < 450")
    check_against_batch(spark, counters, prefix)
    report = stream_report(counters, 3, CM, CS)
    row = report.errors.first()
    assert (row.processed, row.distinct_items) == (450, prefix.select("item").distinct().count())
    assert all(r.cm_est >= r.freq for r in report.listing.collect())


def test_short_stream_ends(spark, files, tmp_path):
    counters = count_prefix(
        stream(spark, files), 5000, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"),
        trigger={"availableNow": True},
    )
    check_against_batch(spark, counters, spark.read.parquet(files))


def test_open_stream_stops_at_t(spark, files, tmp_path):
    """A processing-time trigger never ends by itself; reaching T must stop the query."""
    counters = count_prefix(
        stream(spark, files), 450, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp")
    )
    assert sum(r.freq for r in frequencies_of(counters).collect()) == 450
    assert spark.streams.active == []


def test_resumes_with_what_was_counted(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("items", "out", "cp"))

    def arrive(low, high):
        rows = [(s, item_of(s)) for s in range(low, high)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        return count_prefix(stream(spark, folder), 450, CM, CS, out, checkpoint, {"availableNow": True}, "seq")

    # The source dries up before T, goes on later, and goes on further beyond T.
    for low, high in ((0, 300), (300, 600), (600, 700)):
        arrive(low, high)
        check_against_batch(spark, run(), spark.read.parquet(folder).where("seq < 450"))


def test_replayed_batch_counts_once(spark, files, tmp_path):
    """A batch that was written but not committed runs again under the same number."""
    out, checkpoint = str(tmp_path / "out"), tmp_path / "cp"
    count_prefix(stream(spark, files), 5000, CM, CS, out, str(checkpoint), {"availableNow": True})
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    counters = count_prefix(stream(spark, files), 5000, CM, CS, out, str(checkpoint), {"availableNow": True})
    check_against_batch(spark, counters, spark.read.parquet(files))


def test_text_stream(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text("5\n-3\n5\n")
    (folder / "b.txt").write_text("7\n")
    items = parse_items(stream_lines(spark, str(folder), max_files_per_trigger=1))
    counters = count_prefix(
        items, 10, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}
    )
    assert rows_of(frequencies_of(counters)) == Counter({(5, 2): 1, (-3, 1): 1, (7, 1): 1})


def test_bad_item_fails_the_query(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text("5\nfive\n")
    items = parse_items(stream_lines(spark, str(folder)))
    with pytest.raises(Exception, match="not a 32-bit integer"):
        count_prefix(items, 10, CM, CS, str(tmp_path / "o"), str(tmp_path / "c"), {"availableNow": True})


def test_empty_source(spark, tmp_path):
    folder = tmp_path / "items"
    folder.mkdir()
    counters = count_prefix(
        stream(spark, str(folder)), 10, CM, CS, str(tmp_path / "o"), str(tmp_path / "c"), {"availableNow": True}
    )
    assert counters.count() == 0
    with pytest.raises(ValueError):
        count_prefix(stream(spark, str(folder)), 0, CM, CS, str(tmp_path / "o"), str(tmp_path / "c"))


def counters_of(spark, rows):
    return spark.createDataFrame(rows, "kind string, d int, key int, counter bigint")


def bytes_below(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_what_is_read_back_does_not_grow_with_the_batches(spark, tmp_path):
    """The same keys change in every batch; snapshots keep the number and size of files level."""
    out = tmp_path / "out"
    versions = CounterVersions(str(out), snapshot_every=3)
    files, sizes = [], []
    for batch_id in range(18):
        versions.write(counters_of(spark, [("exact", 0, k, batch_id * 100 + k) for k in range(50)]).coalesce(1), batch_id)
        latest = versions.latest(spark)
        assert {r.key: r.counter for r in latest.collect()} == {k: batch_id * 100 + k for k in range(50)}
        files.append(len(latest.inputFiles()))
        sizes.append(bytes_below(out))
    assert max(files[9:]) <= max(files[:9]) and max(sizes[9:]) <= 1.1 * max(sizes[:9])
    assert len(versions.snapshots(spark)) == 2 and len(list((out / "delta").iterdir())) <= 6
    # Another reader, and a writer that starts anew, find the same.
    assert rows_of(latest_counters(spark, str(out))) == rows_of(versions.latest(spark))
    fresh = CounterVersions(str(out), snapshot_every=3)
    fresh.write(counters_of(spark, [("exact", 0, 1, -5)]), 17)  # replayed behind its snapshot
    assert rows_of(fresh.latest(spark)) == rows_of(versions.latest(spark))
    fresh.write(counters_of(spark, [("exact", 0, 1, 7), ("count", 2, 1, 9)]), 18)
    found = {(r.kind, r.key): r.counter for r in fresh.latest(spark).collect()}
    assert found["exact", 1] == 7 and found["count", 1] == 9 and found["exact", 2] == 1702
    with pytest.raises(ValueError):
        CounterVersions(str(out), 0)


def test_a_reader_survives_the_next_snapshot(spark, tmp_path):
    versions = CounterVersions(str(tmp_path / "out"), snapshot_every=2)
    for batch_id in range(5):
        versions.write(counters_of(spark, [("exact", 0, batch_id, batch_id)]), batch_id)
    planned = versions.latest(spark)
    versions.write(counters_of(spark, [("exact", 0, 9, 9)]), 5)  # takes a snapshot
    assert {r.key for r in planned.collect()} == set(range(5))


def test_snapshots_of_a_stream_equal_batch(spark, files, tmp_path):
    out = str(tmp_path / "out")
    counters = running_counters(stream(spark, files), CM, CS)
    start_counters(counters, out, str(tmp_path / "cp"), snapshot_every=2).awaitTermination()
    assert CounterVersions(out).snapshots(spark) == [1, 3]
    check_against_batch(spark, latest_counters(spark, out), spark.read.parquet(files))


@pytest.fixture()
def staged(spark, tmp_path):
    folder = str(tmp_path / "staged")
    rows = [((s * 7919) % 1000, item_of((s * 7919) % 1000)) for s in range(1000)]
    stage_in_order(spark.createDataFrame(rows, SCHEMA).repartition(4), "seq", 5, folder)
    return folder


def test_staged_files_follow_each_other(spark, staged, tmp_path):
    files = sorted(map(tuple, staged_files(spark, staged, "seq").collect()))
    assert len(files) == 5 and sum(n for _, n, _, _ in files) == 1000
    assert all(a[3] + 1 == b[2] for a, b in zip(files, files[1:]))
    seen = []
    query = (
        replay(spark, staged, SCHEMA).writeStream.foreachBatch(lambda b, i: seen.append((b.agg(F.min("seq")).first()[0], b.count())))
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.awaitTermination()
    assert seen == [(first, n) for _, n, first, _ in files]
    with pytest.raises(ValueError):
        stage_in_order(spark.range(3), "id", 0, str(tmp_path / "none"))


def test_the_cut_falls_inside_a_later_batch(spark, staged, tmp_path):
    third = sorted(map(tuple, staged_files(spark, staged, "seq").collect()))[2]
    t = third[2] + third[1] // 2  # items are numbered from 0
    out = str(tmp_path / "out")
    counters = count_prefix(replay(spark, staged, SCHEMA), t, CM, CS, out, str(tmp_path / "cp"), {"availableNow": True}, "seq")
    check_against_batch(spark, counters, spark.read.parquet(staged).where(F.col("seq") < t))
    assert sorted(r.batch_id for r in spark.read.parquet(f"{out}/done").collect()) == [0, 1, 2]


def test_updates_without_a_line_do_not_count(spark, files, tmp_path):
    """What a batch wrote before it was found to cross T, or before a crash, is not read."""
    out = str(tmp_path / "out")
    counters = count_prefix(stream(spark, files), 450, CM, CS, out, str(tmp_path / "cp"), {"availableNow": True}, "seq")
    want = rows_of(counters)
    spark.createDataFrame([("exact", 0, 1, 99)], "kind string, d int, key int, delta bigint").write.parquet(f"{out}/updates/batch_id=77")
    assert rows_of(prefix_counters(spark, out)) == want


def test_a_batch_is_read_once(spark, files, tmp_path):
    """Far from T the source hands out every row once; the plan has one scan of the batch."""
    rows = []
    query_rows = replay(spark, files, SCHEMA)
    spark.streams.addListener(listener := _RowListener(rows))
    try:
        count_prefix(query_rows, 10**6, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}, "seq")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [n for n in rows if n] == [PER_FILE] * FILES
    frame = batch_updates(spark.read.parquet(files), CM, CS)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1, final


class _RowListener(StreamingQueryListener):
    def __init__(self, rows):
        self.rows = rows

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def test_items_as_bytes(spark, tmp_path):
    """Message queues deliver binary values."""
    folder = str(tmp_path / "bytes")
    spark.createDataFrame([(bytearray(b"12"),), (bytearray(b"-7"),), (bytearray(b"12"),)], "value binary").coalesce(1).write.parquet(folder)
    items = parse_items(spark.readStream.schema("value binary").parquet(folder))
    counters = count_prefix(items, 10, CM, CS, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    assert rows_of(frequencies_of(counters)) == Counter({(12, 2): 1, (-7, 1): 1})
