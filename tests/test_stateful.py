"""Streams with state of their own, against batch queries on the same rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from opinara.functions.text import dedup_key
from opinara.streaming import stateful as ST

COUNT = itertools.count()


def batches(spark, frames, path):
    """A stream whose micro-batches are the given frames, in order, one file each."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/part-{k}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part-*")


def run(stream, tmp_path, mode="append"):
    name = f"out{next(COUNT)}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


REVIEWS = "project_id int, review_id int, ts timestamp, text string"


def test_a_repeat_is_flagged_however_late(spark, tmp_path):
    frames = [
        spark.createDataFrame([(0, 1, day(0), "One text"), (0, 2, day(0, 1), "one  TEXT"), (1, 3, day(0), "one text")], REVIEWS),
        spark.createDataFrame([(0, 4, day(30), "<b>one</b> text"), (0, 5, day(30), "new"), (0, 6, None, None)], REVIEWS),
        spark.createDataFrame([(0, 7, day(1), "new"), (0, 8, day(400), "old one")], REVIEWS),
    ]
    known = spark.createDataFrame([(0, "old one", 90), (0, "old one", 80)], "project_id int, text string, review_id int").select("project_id", F.sha2(dedup_key(F.col("text")), 256).alias("norm_hash"), "review_id")
    got = {r.review_id: (r.is_duplicate, r.first_id) for r in run(ST.first_seen_ever(batches(spark, frames, tmp_path / "in"), known), tmp_path)}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 3), 4: (True, 1), 5: (False, 5), 6: (False, 6), 7: (True, 5), 8: (True, 80)}


def test_a_run_goes_on_where_the_last_one_stopped_and_a_replay_adds_nothing(spark, tmp_path):
    def go():
        source = spark.readStream.schema(REVIEWS).parquet(str(tmp_path / "in/*"))
        write = ST.once_per_batch(str(tmp_path / "out"))

        def twice(df, n):  # a batch that was written before its commit was noted comes again
            write(df, n)
            write(df, n)

        q = ST.first_seen_ever(source).writeStream.outputMode("append").foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k, ts in enumerate((0, 10)):
        spark.createDataFrame([(0, 2 * k, day(ts), "same"), (0, 2 * k + 1, day(ts), f"other {k}")], REVIEWS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        go()
    got = {r.review_id: r.is_duplicate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False} and spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("days, baseline", [(1, 1), (3, 7), (500, 2)])
def test_windows_equal_the_batch_query(spark, tmp_path, days, baseline):
    rng = random.Random(days)
    rows = sorted(((rng.choice("ab"), day(rng.randint(0, 40), rng.randint(0, 23))) for _ in range(120)), key=lambda r: r[1] + dt.timedelta(hours=rng.randint(0, 40)))
    frames = [spark.createDataFrame(rows[k : k + 20], "theme string, ts timestamp") for k in range(0, 120, 20)]
    # a row that is far in the future closes all days before it
    frames += [spark.createDataFrame([("z", day(90))], "theme string, ts timestamp"), spark.createDataFrame([("z", day(91)), ("z", None)], "theme string, ts timestamp")]
    got = {(r.theme, r.day): (r.current_count, r.baseline_count) for r in run(ST.adjacent_windows(batches(spark, frames, tmp_path / "in"), days, baseline, delay="3 days"), tmp_path)}
    days = min(days, 180)
    number = lambda t: (t.date() - dt.date(1970, 1, 1)).days
    all_days = [(a, number(t)) for a, t in rows]
    total = lambda a, lo, hi: sum(b == a and lo <= d <= hi for b, d in all_days)
    assert {k: v for k, v in got.items() if k[0] != "z"} == {(a, d): (total(a, d - days + 1, d), total(a, d - days - baseline + 1, d - days)) for a, d in set(all_days)}


def test_alerts_are_raised_in_order_over_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("rs"), rng.randint(0, 1), day(0, k), rng.choice([True, False, None])) for k in range(80)]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=rng.randint(0, 20)))
    kind = "rule string, project_id int, ts timestamp, triggered boolean"
    frames = [spark.createDataFrame(late[k : k + 10], kind) for k in range(0, 80, 10)] + [spark.createDataFrame([("z", 0, day(30 + k), False)], kind) for k in range(2)]
    got = sorted((r.rule, r.project_id, r.ts) for r in run(ST.raised_in_order(batches(spark, frames, tmp_path / "in"), "1 day"), tmp_path))
    want = []
    for key in {r[:2] for r in rows}:
        was = False
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            if r[3] and not was:
                want.append((*key, r[2]))
            was = bool(r[3])
    assert got == sorted(want) and want
