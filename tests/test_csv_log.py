"""CSV logs in splits against the csv module on whole files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import csv_log
from tidegrid.sources import tables as TB


def whole(path, columns):
    with open(path, newline="", encoding="utf-8-sig") as f:
        return [(i, *(row.get(c) for c in columns)) for i, row in enumerate(csv.DictReader(f), start=2)]


def read(spark, path, columns, block=None, **options):
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = csv_log.numbered_csv(spark, str(path), columns, **options)
        return sorted(tuple(r)[1:] for r in rows.collect()), rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def random_log(path, seed, n=120):
    rng = random.Random(seed)
    cells = ["1", "", " x ", '"a,b"', '"line\nbreak"', '"two\n\nbreaks, and ""quotes"""', '""', 'in"side', '"junk"after', '"[1, 2,\r\n3]"', "é漢", '"' + "long\n" * 40 + '"', "# no comment"]
    rows = ["a,b,c,b" if seed % 2 else "﻿a,b,c"]
    for _ in range(n):
        row = ",".join(rng.choice(cells) for _ in range(rng.randint(1, 5)))
        rows += [row] + ([""] if rng.random() < 0.1 else []) + (["  "] if rng.random() < 0.1 else [])
    text = ("\r\n" if seed % 3 == 0 else "\n").join(rows) + rng.choice(["", "\n"])
    path.write_bytes((text + ('1,"never closed\n2,3' if seed == 4 else "")).encode())


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_csv_module(spark, tmp_path, seed):
    path = tmp_path / "log.csv"
    random_log(path, seed)
    columns = ["c", "b", "none", "a"]
    want = sorted(whole(path, columns), key=str)
    for block in (None, 1500, 300):  # blocks that begin and end inside quotes
        got, rows = read(spark, path.parent, columns, block)
        assert sorted(got, key=str) == want, block
    joined, _ = read(spark, path.parent, columns, 300, most_blocks=0)
    assert sorted(joined, key=str) == want


def test_states_of_lines():
    rng = random.Random(1)
    lines = ["a,b", '"a', 'a"b', '"a""', '"a"""', '"a","b', 'x,"a,"",b', '",x', "x", 'a,"b"c"d'] + ["".join(rng.choice('"",,a ') for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for line in lines:
        for inside in (False, True):
            rows = list(csv.reader(['"' * inside + line + "\n", "z\n"]))
            assert csv_log.ends_inside(line, inside) is (len(rows) == 1), (line, inside)


def test_many_columns_and_no_file(spark, tmp_path):
    names = [f"sc_{i:03d}" for i in range(300)]
    (tmp_path / "wide.csv").write_text(",".join(["local_timestamp", *names]) + "\n" + "\n".join(",".join(str(100 * r + i) for i in range(301)) for r in range(5)) + "\n")
    got, _ = read(spark, tmp_path, ["sc_299", "local_timestamp", "sc_064"])
    assert got == [(r + 2, str(100 * r + 300), str(100 * r), str(100 * r + 65)) for r in range(5)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    (tmp_path / "none" / "head.csv").write_text("a,b\n")
    assert read(spark, tmp_path / "none", ["a"])[0] == []


def test_a_resampled_log_is_read_back(spark, tmp_path):
    from tidegrid.operators import segments as G

    log = spark.createDataFrame([("s", i + 2, t, [float(i + k) for k in range(114)]) for i, t in enumerate([0, 10, 30, 90])], "source string, row_no int, t_us long, amp array<double>")
    steps = G.resampled(log, G.Grid(10, 4, 3), ["amp"])
    flat = TB.resampled_csv(steps, "amp", 114).orderBy("segment_id", "step_index")
    flat.coalesce(1).write.option("header", True).csv(str(tmp_path / "out"))
    columns = [c for c in flat.columns if c != "source_csv"]
    with pytest.raises(ValueError):
        csv_log.numbered_csv(spark, str(tmp_path / "out"), columns)
    got = csv_log.numbered_csv(spark, str(tmp_path / "out"), columns, names=("file", "line")).orderBy("line").collect()
    want = flat.select(*(F.col(c).cast("string").alias(c) for c in columns)).collect()
    assert [tuple(r)[2:] for r in got] == [tuple("" if v is None else v for v in r) for r in want] and len(got) == 5


def test_several_tasks_read_one_large_file(spark, tmp_path):
    """A log of 100 MB with quoted breaks: several blocks, in tasks of their own, with the right numbers."""
    cell = "[" + ", ".join(str(i % 90) for i in range(384)) + "]"
    with open(tmp_path / "large.csv", "w") as f:
        f.write("local_timestamp,len,data,note\n")
        for i in range(75_000):
            f.write(f'{i * 10},384,"{cell}","a\n{i}"\n')
    rows = csv_log.numbered_csv(spark, str(tmp_path), ["local_timestamp", "note"])
    n = spark.sparkContext.defaultParallelism
    found = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum((F.col("local_timestamp").cast("long") != (F.col("source_row_number") - 2) * 10).cast("long")).alias("off"), F.sum((F.col("note") != F.concat(F.lit("a\n"), (F.col("source_row_number") - 2).cast("string"))).cast("long")).alias("noted")).collect()
    assert sum(r.n for r in found) == 75_000 and sum(r.off + r.noted for r in found) == 0
    assert len([r for r in found if r.n > 1000]) >= min(n, 4)
