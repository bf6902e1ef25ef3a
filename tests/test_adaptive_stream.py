"""The stream of adaptive segments against the log's, over micro-batches and a restart."""

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from tidegrid.operators import adaptive as A
from tidegrid.streaming.adaptive import AdaptiveProcessor, adaptive_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_log(rocks, tmp_path):
    spark, rng = rocks, random.Random(6)
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=6, relative=0.18, absolute_us=2.0, long_factor=3.5)
    rows = []
    for source, n in [("long", 120), ("other", 60), ("short", 4), ("single", 1)]:
        t = 0
        for i in range(n):
            t += rng.choice([100, 101, 99, 200, 300, 1000, 0, -5, 150])
            rows.append((source, i + 2, t))
    parts = [[r for r in rows if (r[1] - 2) // 15 == k] for k in range(8)]
    schema = "source string, row_no int, t_us long"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(k, part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/batch={k}")
        time.sleep(0.05)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        query = adaptive_stream(stream, a, None).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(100)

    for k in range(4):
        put(k, parts[k])
    run()
    for k in range(4, 8):
        put(k, parts[k])
    run()  # goes on from the checkpoint

    columns = ["source", "row_no", "gap_us", "k", "base_gap_us", "segment_id", "split_reason"]
    want = {(r.source, r.row_no): tuple(r) for r in A.adaptive_segments(spark.createDataFrame(rows, schema), a).select(*columns).collect() if r.source in ("long", "other")}
    got = {(r.source, r.row_no): tuple(r) for r in spark.read.parquet(out).select(*columns).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g[:4] == w[:4] and g[5:] == w[5:] and g[4] == pytest.approx(w[4]), key


def test_stream_without_timers_ends_with_its_input(rocks, tmp_path):
    spark = rocks
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=2, relative=0.18, absolute_us=2.0)
    rows = [("a", i, 100 * i) for i in range(5)] + [("b", 1, 7)]
    spark.createDataFrame(rows, "source string, row_no int, t_us long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, row_no int, t_us long").parquet(str(tmp_path / "in"))
    query = adaptive_stream(stream, a, None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    assert sorted(r.row_no for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]  # b still waits


class Handle:
    """State and timers in memory."""

    def __init__(self):
        self.values, self.lists, self.timers = {}, {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return SimpleNamespace(exists=lambda: name in self.values, get=lambda: self.values[name], update=lambda v: self.values.__setitem__(name, v))

    def getListState(self, name, schema):  # noqa: N802
        return SimpleNamespace(get=lambda: iter(self.lists.get(name, [])), put=lambda v: self.lists.__setitem__(name, v), clear=lambda: self.lists.pop(name, None))

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


def test_a_silent_source_takes_what_it_has(spark):
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=6, relative=0.18, absolute_us=2.0)
    rows = [(2, 0), (3, 100), (4, 90), (5, 290), (6, 400)]
    processor, handle = AdaptiveProcessor(a, 50), Handle()
    processor.init(handle)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)
    frame = lambda part: iter([pd.DataFrame(part, columns=["row_no", "t_us"])])
    assert list(processor.handleInputRows(("s",), frame(rows[:2]), now)) == [] == list(processor.handleInputRows(("s",), frame(rows[2:4][::-1]), now))
    assert handle.timers == [1050]  # the earlier one is gone
    found = pd.concat(processor.handleExpiredTimer(("s",), now, None))
    found = pd.concat([found, *processor.handleInputRows(("s",), frame(rows[4:]), now)])
    table = spark.createDataFrame([("s", *r) for r in rows[:4]], "source string, row_no int, t_us long")
    want = A.adaptive_segments(table, a).orderBy("row_no").toPandas()
    for c in ("row_no", "gap_us", "k", "base_gap_us", "segment_id", "split_reason"):
        assert [None if pd.isna(x) else x for x in found[c].iloc[:4]] == [None if pd.isna(x) else x for x in want[c]], c
    assert len(found) == 5 and found["gap_us"].iloc[4] == 110 and handle.lists == {}
