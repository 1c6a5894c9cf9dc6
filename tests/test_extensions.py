"""Sources, tools, dispatch modes and outside scorers that users plug in."""

from __future__ import annotations

import threading
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rollsmith.functions import calls, tools
from rollsmith.operators import dispatch as D
from rollsmith.sources import plugin


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        pq.write_table(pa.table({"n": pa.array(range(i * 10, i * 10 + 10), pa.int64()), "s": [f"é{i}"] * 9 + [None]}), tmp_path / "in" / f"{i}.parquet", row_group_size=4)
    return str(tmp_path / "in")


def test_batches_have_a_task_for_each_shard(spark, files):
    df = spark.read.format(plugin.register(spark, plugin.RowGroups)).option("path", files).load()
    assert df.rdd.getNumPartitions() == 9 and df.agg(F.sum("n"), F.count("s")).first() == (435, 27)
    assert spark.read.format("row_groups").option("path", f"{files}/1.parquet").load().count() == 10


def test_a_stream_goes_on_where_it_stopped(spark, files, tmp_path):
    def run():
        stream = spark.readStream.format(plugin.register(spark, plugin.RowGroups)).option("path", files).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        query.stop()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    assert sum(run()) == 30 and run() == []
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n"), F.count("*")).first() == (435, 30)
    pq.write_table(pa.table({"n": pa.array([1000], pa.int64()), "s": ["x"]}), f"{files}/9.parquet")
    assert sum(run()) == 1
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n"), F.count("*")).first() == (1435, 31)


def test_a_source_from_a_file(spark, tmp_path):
    (tmp_path / "mine.py").write_text(
        "from rollsmith.sources.plugin import ShardSource\n\nclass Squares(ShardSource):\n    @classmethod\n    def name(cls):\n        return 'squares'\n\n    def schema(self):\n        return 'n long, square long'\n\n"
        "    def shards(self):\n        return list(range(int(self.options.get('n', 0))))\n\n    def records(self, shard, schema):\n        yield (shard, shard * shard)\n"
    )
    name = plugin.register_from(spark, str(tmp_path / "mine.py"), "Squares")
    assert sorted(map(tuple, spark.read.format(name).option("n", 4).load().collect())) == [(0, 0), (1, 1), (2, 4), (3, 9)]
    assert spark.read.format(name).load().collect() == []
    with pytest.raises(AttributeError):
        plugin.register_from(spark, str(tmp_path / "mine.py"), "Cubes")
    with pytest.raises(TypeError):
        plugin.register(spark, int)


def test_tools_by_name(spark):
    tools.register_tools(spark)
    rows = [(1, [("user", "ab1"), ("assistant", None), ("user", "ab1")]), (2, []), (3, None), (1, [(None, "é")])]
    spark.createDataFrame(rows, "id long, turns array<struct<role:string,text:string>>").createOrReplaceTempView("told")
    letters = spark.sql("SELECT id, r.* FROM told, LATERAL tool_turns('letters', turns) r")
    assert letters.columns == ["id", "place", "role", "letters", "so_far"]
    assert sorted(map(tuple, letters.collect()), key=repr) == [(1, 0, "user", 2, 2), (1, 0, None, 0, 0), (1, 1, "assistant", 0, 2), (1, 2, "user", 2, 4)]
    assert spark.sql("SELECT id, r.* FROM told LEFT JOIN LATERAL tool_turns('repeats', turns) r").where("repeated").select("place", "first_turn").collect() == [(2, 0)]
    with pytest.raises(Exception, match="unknown tool"):
        spark.sql("SELECT r.* FROM told, LATERAL tool_turns('none', turns) r").collect()
    with pytest.raises(ValueError):
        tools.tool("letters")(tools.Repeats)


def numbering():
    """Work that adds its worker's number; made here so that it is sent by value."""

    def numbered(worker, frames):
        for rows in frames:
            yield pd.DataFrame({"n": rows["n"], "by": [worker] * len(rows)})

    return numbered


@pytest.mark.parametrize("n, workers", [(10, 4), (3, 8), (8, 4), (0, 3), (1, 1)])
def test_dispatch_modes(spark, n, workers):
    df = spark.range(n).select((F.col("id") * 3).alias("n"), (F.col("id") % 5).cast("int").alias("worker"))
    run = lambda how: [(r["place"], r["n"], r["by"]) for r in D.dispatch(df, how, workers, ["n"], numbering(), "n long, by int").orderBy("place", "by").collect()]
    share = max(1, -(-n // workers))
    assert run("shares") == [(i, 3 * i, i // share) for i in range(n)]
    assert run("one_to_all") == [(i, 3 * i, w) for i in range(n) for w in range(workers)] and run("one_to_all_keep_first") == [(i, 3 * i, 0) for i in range(n)]
    assert run("by_worker") == [(i, 3 * i, i % 5 % workers) for i in range(n)]


def test_equal_shares_are_filled_from_the_start(spark):
    seen = lambda worker, frames: (pd.DataFrame({"rows": [",".join(map(str, rows["n"]))] * len(rows)}) for rows in frames)
    D.MODES["all"] = (D.MODES["shares"][0], lambda results: results)
    got = D.dispatch(spark.range(3).withColumnRenamed("id", "n"), "all", 5, ["n"], seen, "rows string").select("worker", "rows").distinct().collect()
    del D.MODES["all"]
    assert sorted(map(tuple, got)) == [(0, "0"), (1, "1"), (2, "2"), (3, "0"), (4, "1")]
    with pytest.raises(ValueError):
        D.mode("shares", None, None)
    with pytest.raises(ValueError):
        D.dispatch(spark.range(1), "no", 1, ["id"], numbering(), "n long")


def scored(values, call, **options):
    """The scores that a task of ``bounded_calls`` gives, without Spark around it."""
    taken = {}

    class Frame:
        class schema:
            pass

        def __init__(self):
            self.schema = []

        def mapInArrow(self, run, schema):
            taken["run"] = run

    calls.bounded_calls(Frame(), "v", call, **options)
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.int64())], names=["v"]) for part in values]
    return [b.column("score").to_pylist() for b in taken["run"](iter(batches))]


def test_calls_are_bounded_and_in_order():
    now, most, lock = [0], [0], threading.Lock()

    def call(value, attempt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (7 - value % 7))
        with lock:
            now[0] -= 1
        return value / 2

    values = [list(range(60)), [], list(range(60, 80))]
    assert scored(values, call, most=5, window=9) == [[v / 2 for v in part] for part in values]
    assert 2 <= most[0] <= 5


def test_failures_retries_and_timeouts():
    tried = []

    def call(value, attempt):
        tried.append((value, attempt))
        if value == 3 or value == 2 and attempt < 2:
            raise OSError
        if value == 4:
            time.sleep(1.5)
        return 1.0 if value is not None else 0.25

    began = time.monotonic()
    assert scored([[1, 2, 3, 4, 5, None]], call, most=2, window=3, timeout=0.3, retries=2, failed=-1.0) == [[1.0, 1.0, -1.0, -1.0, 1.0, 0.25]]
    assert time.monotonic() - began < 1.4 and tried.count((3, 2)) == 1 and (3, 3) not in tried
    with pytest.raises(ValueError):
        scored([[1]], call, most=4, window=2)


def test_a_column_of_calls(spark):
    df = calls.bounded_calls(spark.range(20).withColumn("score 1", F.lit("x")), "id", lambda v, attempt: v / 4)
    assert df.columns == ["id", "score 1", "score"] and [r["score"] for r in df.orderBy("id").collect()] == [i / 4 for i in range(20)]
