"""Streams with keyed state against what a batch makes of all their events."""

import datetime as dt
import random
import time

from tessellum.streaming import keyed, status

FILES = "file_id long, status string, ts timestamp, event_id long"
RESULTS = "query_id long, seq long, type string, payload string"


def arrive(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, tmp_path, schema, shape):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = keyed.keep(shape(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert query.awaitTermination(60)
    assert query.exception() is None
    return query


def state_rows(query):
    return [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]


def test_out_of_order_and_late_events_are_the_batch(spark, tmp_path):
    draw = random.Random(3)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    names = ["pending", "extracting", "vectorizing", "completed"]
    rows = [(i % 9, names[draw.randrange(4)], at(draw.randrange(30)), i) for i in range(120)] + [(None, "pending", at(1), 500), (20, "completed", None, 501), (20, "pending", at(2), None)]
    draw.shuffle(rows)
    for part in (rows[:50], rows[50:90]):
        arrive(spark, part, FILES, tmp_path, 0)
    shape = lambda df: keyed.live_status(df, idle=0.5)
    run(spark, tmp_path, FILES, shape)
    time.sleep(1)
    arrive(spark, [(99, "pending", at(99), 900)], FILES, tmp_path, 1)  # time goes on: silent files are let go
    query = run(spark, tmp_path, FILES, shape)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("silent").select("file_id").distinct().count() >= 9
    arrive(spark, rows[90:], FILES, tmp_path, 2)  # events of files whose state has gone, some older than what has been seen
    run(spark, tmp_path, FILES, shape)
    batch = status.latest_status(spark.read.schema(FILES).parquet(f"{tmp_path}/in"))
    got = keyed.current(spark.read.parquet(f"{tmp_path}/out")).select(batch.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.collect()))
    assert min(state_rows(query)) <= 2  # of eleven files those that are not silent alone have a state


def test_results_come_in_order(spark, tmp_path):
    first = [(1, 2, "answer_chunk", "c"), (1, 0, "stage_update", "a"), (2, 1, "final_answer", "two"), (3, 0, "error", "x")]
    arrive(spark, first, RESULTS, tmp_path, 0)
    shape = lambda df: keyed.ordered_results(df, wait=0.5, idle=60)
    run(spark, tmp_path, RESULTS, shape)
    read = lambda: spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, read().select("query_id", "seq", "late").collect())) == [(1, 0, False), (3, 0, False)]
    arrive(spark, [(1, 1, "answer_chunk", "b"), (1, 4, "final_answer", "new"), (1, 3, "final_answer", "old")], RESULTS, tmp_path, 1)
    run(spark, tmp_path, RESULTS, shape)
    time.sleep(1)
    arrive(spark, [(4, 0, "stage_update", "s")], RESULTS, tmp_path, 2)  # query 2 waits for its number 0 no longer
    run(spark, tmp_path, RESULTS, shape)
    arrive(spark, [(2, 0, "stage_update", "late"), (2, 2, "answer_chunk", "t")], RESULTS, tmp_path, 3)
    run(spark, tmp_path, RESULTS, shape)
    rows = [tuple(r) for r in read().select("batch", "query_id", "seq", "payload", "late").collect()]
    in_time = [[seq for _, q, seq, _, late in sorted(rows, key=lambda r: r[0]) if q == k and not late] for k in (1, 2, 3, 4)]
    assert in_time == [[0, 1, 2, 3, 4], [1, 2], [0], [0]]
    assert [r[1:] for r in rows if r[4]] == [(2, 0, "late", True)]
    given = spark.read.schema(RESULTS).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, keyed.answers(read()).collect()))
    assert got == sorted(map(tuple, keyed.answers(given).collect()))
    assert got == [(1, True, "new", 5), (2, True, "two", 3), (3, False, "{}", 1), (4, True, "{}", 1)]
