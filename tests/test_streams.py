"""Streams that stop in between, and keys that end."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rollsmith.streaming import commits
from rollsmith.streaming.groups import BUCKETS, closing_state, gather_closing
from rollsmith.streaming.streams import source

SCHEMA = "n long"


def arrivals(spark, folder, files):
    for i, numbers in enumerate(files):
        spark.createDataFrame([(n,) for n in numbers], SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_a_log_that_stops_between_write_and_commit(spark, tmp_path, monkeypatch):
    stream = arrivals(spark, tmp_path / "in", [[1, 2], [3], [4, 5]])
    total = lambda b: b.agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    folder, calls = str(tmp_path / "log"), []

    def stops(rows, path, number, write=commits.write_number):
        write(rows, path, number)
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("stopped after the write")

    monkeypatch.setattr(commits, "write_number", stops)
    with pytest.raises(StreamingQueryException):
        commits.step_log(stream, "log", total, folder)
    left = commits.read_numbers(spark, f"{folder}/rows", total(spark.createDataFrame([], SCHEMA)).schema, commits.last_committed(spark, folder))
    assert [r["batch"] for r in left.collect()] == [0]
    log = commits.step_log(stream, "log", total, folder)
    assert calls == [0, 1, 1, 2] and sorted(map(tuple, log.select("batch", "rows").collect())) == [(0, log.where("batch = 0").first()["rows"]), (1, log.where("batch = 1").first()["rows"]), (2, log.where("batch = 2").first()["rows"])]
    assert log.agg(F.sum("total"), F.sum("rows")).first() == (15, 5)
    # Nothing new: the log is as it was.
    assert commits.step_log(stream, "log", total, folder).agg(F.sum("total")).first()[0] == 15


@pytest.mark.parametrize("where", ["prepare", "consume", "between"])
def test_pipelined_steps_that_stop(spark, tmp_path, where):
    stream = arrivals(spark, tmp_path / "in", [[1, 2], [3], [4, 5], [6]])
    folder, out, state = str(tmp_path / "steps"), str(tmp_path / "out"), {"failed": False, "prepared": 0}
    order = []

    def fails(now):
        if now and not state["failed"]:
            state["failed"] = True
            raise RuntimeError("stopped")

    def prepare(batch):
        state["prepared"] += 1
        fails(where == "prepare" and state["prepared"] == 3)
        return batch.withColumn("twice", F.col("n") * 2)

    def consume(rows, number):
        fails(where == "consume" and number == 1)
        commits.write_number(rows, out, number)
        order.append(number)
        fails(where == "between" and number == 1)

    with pytest.raises((StreamingQueryException, RuntimeError)):
        commits.one_ahead(stream, "steps", prepare, consume, folder)
    commits.one_ahead(stream, "steps", prepare, consume, folder)
    assert order == sorted(order) and set(order) == {0, 1, 2, 3}
    assert spark.read.parquet(out).agg(F.sum("n"), F.sum("twice"), F.count("*")).first() == (21, 42, 6)
    before = list(order)
    commits.one_ahead(stream, "steps", prepare, consume, folder)
    assert order == before


def test_no_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    log = commits.step_log(stream, "log", lambda b: b.agg(F.sum("n").alias("total")), str(tmp_path / "log"))
    assert log.columns == ["total", "batch"] and log.collect() == []


def groups_of(rows, size, gap, mark):
    """The groups that are final at a watermark, in plain Python."""
    out = []
    for key in {k for k, *_ in rows}:
        mine = sorted((t, o, v) for k, t, o, v in rows if k == key)
        lives = []
        for r in mine:
            if lives and r[0] - lives[-1][-1][0] <= gap:
                lives[-1].append(r)
            else:
                lives.append([r])
        for life in lives:
            for g in range(0, len(life), size):
                group = life[g : g + size]
                if life[-1][0] + gap <= mark or len(group) == size and group[-1][0] <= mark:
                    out.append((key, life[0][0], g // size, [v for *_, v in group], len(group) == size))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_keys_that_close_leave_no_state(spark, tmp_path, files):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, k * 7 + 60 * i + (3600 * 3 if i > 6 else 0), i, float(i)) for k in range(5) for i in range(10)] + [(9, 40 * 3600, 0, 1.0), (9, 100 * 3600, 1, 2.0), (9, 100 * 3600, 2, 3.0)]
    rows.sort(key=lambda r: r[1])
    schema = "k long, ts timestamp, o long, v double"
    size = -(-len(rows) // files)
    for i in range(files):
        part = [(k, base + dt.timedelta(seconds=t), o, v) for k, t, o, v in rows[i * size : (i + 1) * size]] + ([(None, base, 0, 0.0), (3, None, 0, 0.0)] if not i else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    stream = source(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    with closing_state(spark):
        query = gather_closing(stream, "k", "v", "o", "ts", size=4, gap="1 hour", late="5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted((r["k"], int((r["start"] - base).total_seconds()), r["group"], list(r["values"]), r["complete"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == groups_of(rows, 4, 3600, 100 * 3600 - 300)
    # Of keys 0 to 4 nothing is left; key 9 still holds two rows (a list's elements, its length, a timer).
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_keys_share_states_and_timers(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, 60 * i + k % 7, i, float(i)) for k in range(700) for i in range(3 + k % 4)] + [(-1, 3600 * 2, 0, 1.0)]
    schema = "k long, ts timestamp, o long, v double"
    spark.createDataFrame([(k, base + dt.timedelta(seconds=t), o, v) for k, t, o, v in rows], schema).write.parquet(str(tmp_path / "in"))
    stream = source(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 9)
    with closing_state(spark):
        query = gather_closing(stream, "k", "v", "o", "ts", size=4, gap="2 hours", late="5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted((r["k"], int((r["start"] - base).total_seconds()), r["group"], list(r["values"]), r["complete"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == groups_of(rows, 4, 7200, 7200 - 300) and len(found) == 525
    # All lives are open: a value and a timer (kept twice) for each bucket, not for each key.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * BUCKETS < 3 * 701
