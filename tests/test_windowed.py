from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gradelattice.operators import enumerate as en
from gradelattice.streaming.windowed import WindowedContexts, graded, window_counts

START = datetime(2024, 1, 4)  # windows of 7 days begin on Thursdays, as the epoch does
SCHEMA = "ts timestamp, user bigint, kind int"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, contexts, folder, progress, late):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    contexts.start(stream, progress, time="ts", window="7 days", late=late, obj=F.col("user"), attr=F.col("kind")).awaitTermination()


def test_late_events_count_until_the_watermark_has_passed(spark, tmp_path):
    folder, state, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    day = lambda d: START + timedelta(days=d)
    parts = [[(day(1), 1, 0), (day(2), 1, 0), (day(2), 2, 1), (None, 1, 1), (day(3), 1, None)],
             [(day(8), 1, 1), (day(3), 1, 1)],        # three days late within ten: counts
             [(day(30), 2, 0)],                       # moves the watermark to day 20
             [(day(4), 2, 1), (day(25), 2, 1), (day(31), 1, 1)]]  # the first is too late by now
    for rows in parts:
        feed(spark, folder, rows)
        contexts = WindowedContexts(spark, 2, state)  # as after a restart
        run(spark, contexts, folder, progress, "10 days")
    got = {((r.start - START).days, r.obj): r.counts for r in contexts.counts.collect()}
    assert got == {(0, 1): [2, 1], (0, 2): [0, 1], (7, 1): [0, 1], (28, 2): [1, 0], (28, 1): [0, 1], (21, 2): [0, 1]}
    one = contexts.context(START)
    assert sorted((r.obj, tuple(r.grades)) for r in one.frame.collect()) == [(1, (10, 5)), (2, (0, 10))]
    assert en.concepts(one).count() > 1


def test_stream_equals_batch_and_windows_may_slide(spark, tmp_path):
    rows = [(START + timedelta(hours=7 * k), k % 5, k % 3) for k in range(150)]
    folder = str(tmp_path / "in")
    for k in range(3):
        feed(spark, folder, rows[k::3])
    contexts = WindowedContexts(spark, 3, str(tmp_path / "state"))
    run(spark, contexts, folder, str(tmp_path / "progress"), "1000 days")
    frame = spark.createDataFrame(rows, SCHEMA)
    batch = graded(window_counts(frame, "ts", "7 days", F.col("user"), F.col("kind"), 3), 3)
    assert sorted(map(str, contexts.grades.collect())) == sorted(map(str, batch.collect()))
    sliding = window_counts(frame, "ts", "7 days", F.col("user"), F.col("kind"), 3, slide="1 day")
    assert sliding.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] == 7 * len(rows)
