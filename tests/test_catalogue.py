"""Every registered query against its SQL twin."""

import pytest

from tests.oracle import assert_same, connect
from tidegrid.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), con, catalogue.oracle_sql()[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_one_shuffle_feeds_segmentation(spark, sf_dir):
    from tidegrid.operators import segments as G
    from tidegrid.plans.views import GRID, packets

    plan = G.segmented(packets(spark, sf_dir), GRID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["gap_trimmed_rmse", "resample_complex"])
def test_packets_are_scanned_without_their_vectors(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(t_us" in plan and "lag(re" not in plan and "lag(im" not in plan


def test_no_packet_is_shuffled_with_its_vector(spark, sf_dir):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["gap_trimmed_rmse"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("most", [50_000, 2])
@pytest.mark.parametrize(("name", "copies"), [("gap_trimmed_rmse", 1), ("gap_trimmed_rmse", 2), ("resample_complex", 1)])
def test_vectors_that_are_missing_or_repeated(spark, tmp_path, monkeypatch, name, copies, most):
    """Some numbers have no vector, 3 may have two (alike), one vector has no number; copies leave ties to segments' SQL."""
    import random

    import duckdb
    from pyspark.sql import functions as F

    monkeypatch.setattr("tidegrid.plans.views.MOST_VECTORS", most)
    rng = random.Random(5)
    sf_dir, hour = str(tmp_path), 3_600_000_000
    events = [(i, rng.randrange(400) * hour, rng.randrange(3), rng.random()) for i in range(300)]
    table = spark.createDataFrame(events, "event_id long, t long, user_id long, value double")
    table.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{sf_dir}/events.parquet")
    some = {v: [rng.random() for _ in range(64)] for v in (0, 1, 3, 9, 11, None)}
    spark.createDataFrame([(v, some[v], 0) for v in (0, 1, *[3] * copies, 9, 11, None)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{sf_dir}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    assert assert_same(catalogue.queries()[name](spark, sf_dir), con, catalogue.oracle_sql()[name])
