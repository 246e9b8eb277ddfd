"""First arrivals with late rows: statuses and state over several micro-batches."""
from pyspark.sql import functions as F

from glossa.session import scratch_path
from glossa.streaming import jobs as J

T0 = 1_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, s long").withColumn("event_time", F.timestamp_seconds("s"))


def statuses(spark, folder):
    got = J.read_batches(spark, f"{folder}/rows", "doc_id long, status string, batch int").collect()
    return {r["doc_id"]: (r["batch"], r["status"]) for r in got}


def test_batches_and_state(spark):
    folder = scratch_path(spark, "arrivals")
    batches = [
        [(1, "a", T0 + 5), (2, "a", T0 + 3), (3, "b", T0 - 1), (4, None, T0), (5, None, T0 + 1), (6, "c", None)],
        [(7, "a", T0 + 50), (8, "d", T0 + 200), (9, "old", T0 - 200)],
        [(10, "b", T0 + 210), (11, "a", T0 + 150), (12, "late", T0 + 90)],
        [(13, "d", T0 + 100_000)],
        [(14, "d", T0 + 100_001)],
    ]
    for i, rows in enumerate(batches):
        J.arrivals_batch(frame(spark, rows), folder, i, "event_time", 100)
        J.arrivals_batch(frame(spark, rows), folder, i, "event_time", 100)  # run again after a failure
    assert statuses(spark, folder) == {
        1: (0, "duplicate"), 2: (0, "first"), 3: (0, "first"), 4: (0, "first"), 5: (0, "duplicate"), 6: (0, "late"),
        7: (1, "duplicate"), 8: (1, "first"), 9: (1, "late"),
        10: (2, "first"), 11: (2, "duplicate"), 12: (2, "late"), 13: (3, "duplicate"), 14: (4, "first")}
    marks = {r["batch"]: r for r in J.read_batches(spark, f"{folder}/marks", J.ARRIVAL_MARK + ", batch int").collect()}
    assert [marks[i]["state_rows"] for i in range(5)] == [3, 3, 2, 0, 1]
    assert [marks[i]["late_rows"] for i in range(5)] == [1, 1, 1, 0, 0]


def test_empty_batch_keeps_the_watermark(spark):
    folder = scratch_path(spark, "arrivals")
    J.arrivals_batch(frame(spark, [(1, "a", T0)]), folder, 0, "event_time", 10)
    J.arrivals_batch(frame(spark, []), folder, 1, "event_time", 10)
    J.arrivals_batch(frame(spark, [(2, "a", T0), (3, "b", T0 - 11)]), folder, 2, "event_time", 10)
    assert statuses(spark, folder) == {1: (0, "first"), 2: (2, "duplicate"), 3: (2, "late")}


def test_stream_survives_a_restart(spark):
    inbox, folder, ck = (scratch_path(spark, n) for n in ("inbox", "arrivals", "ck"))
    for i in range(3):
        part = frame(spark, [(10 * i + j, f"t{j % 3}", T0 + 1000 * i + j) for j in range(5)])
        part.write.mode("append").parquet(inbox)
        J.stream_arrivals(spark.readStream.schema(part.schema).parquet(inbox), folder, ck, "event_time", 100).awaitTermination()
    got = statuses(spark, folder)
    assert [got[i][0] for i in (0, 10, 20)] == [0, 1, 2]
    assert [got[i][1] for i in range(5)] == ["first", "first", "first", "duplicate", "duplicate"]
    assert got[20][1] == "first"  # the state of two delays before is gone
