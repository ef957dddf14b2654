"""The event log: ids, whole appends, resumed streams, pushed filters."""

import pytest
from pyspark.sql import functions as F

from marginalia.sources import event_log as L
from marginalia.streaming import jobs as J

SCHEMA = "run_id string, state string, n long, seq long"


def events(spark, start, stop):
    return spark.range(start, stop).selectExpr("concat('r', cast(id % 3 as string)) AS run_id", "if(id % 10 = 9, 'completed', 'running') AS state", "id AS n").repartition(4)


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert L.append_events(events(spark, 0, 0), path, [F.col("n")]) == (0, -1)
    assert L.append_events(events(spark, 0, 25), path, [F.col("n")]) == (0, 24)
    return path


def test_ids_follow_the_order(spark, log):
    assert L.append_events(events(spark, 25, 40), log, [F.col("n")]) == (25, 39)
    rows = L.read_log(spark, log, SCHEMA, rows_per_task="7").collect()
    assert sorted((r.seq, r.n) for r in rows) == [(i, i) for i in range(40)]


def test_a_stopped_stream_goes_on_at_its_cursor(spark, log, tmp_path):
    def run():
        stream = L.stream_log(spark, log, SCHEMA, rows_per_task="4")
        return sorted(r.seq for r in J.run_to_end(J.tail_events(stream), str(tmp_path / "out"), str(tmp_path / "ck")).collect())

    assert run() == list(range(25))
    assert run() == list(range(25))  # nothing new
    L.append_events(events(spark, 25, 31), log, [F.col("n")])
    L.append_events(events(spark, 31, 40), log, [F.col("n")])
    assert run() == list(range(40))


def test_a_stream_begins_after_an_id_and_ends_with_its_run(spark, log, tmp_path):
    stream = J.tail_to_end(L.stream_log(spark, log, SCHEMA, after=4), "seq")
    found = J.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert sorted(r.seq for r in found if r.run_id == "r0") == [6, 9] and min(r.seq for r in found) == 5


def test_an_append_that_fails_leaves_nothing(spark, log):
    broken = events(spark, 25, 30).withColumn("n", F.when(F.col("n") < 28, F.col("n")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        L.append_events(broken, log, [F.col("n")])
    assert L.read_log(spark, log, SCHEMA).count() == 25


def test_filters_choose_ranges(log, spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    from pyspark.sql.types import StructType

    reader = L._Batch(StructType.fromDDL(SCHEMA), {"path": log, "rows_per_task": "5"})
    assert list(reader.pushFilters([GreaterThan(("seq",), 9), LessThanOrEqual(("seq",), 17), EqualTo(("run_id",), "r1")])) == []
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(10, 15), (15, 18)]
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(3).to_pylist()) == [10, 13, 16]
    assert sorted(r.seq for r in L.read_log(spark, log, SCHEMA).where("seq > 20 AND run_id = 'r0'").collect()) == [21, 24]
