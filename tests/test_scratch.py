"""Tables in between go when their scope ends, and at the latest with the driver."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from rollsmith.operators.ranking import indexed
from rollsmith.sources import scratch as S

ROOT = Path(__file__).resolve().parent.parent


def test_a_scope_deletes_what_was_written_in_it(spark):
    with S.scratch_scope():
        outer = S.scratch(spark, "outer")
        spark.range(3).write.parquet(outer)
        with S.scratch_scope():
            rows = indexed(spark.range(10).repartition(3), ["id"])
            inner = list(S._written[-1])
            assert rows.where("index = id").count() == 10 and all(Path(p.removeprefix("file://")).exists() for p in inner) and inner
        assert not any(Path(p.removeprefix("file://")).exists() for p in inner)
        assert spark.read.parquet(outer).count() == 3
    assert not Path(outer.removeprefix("file://")).exists() and len(S._written) == 1


def test_the_rest_goes_with_the_driver(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\nfrom rollsmith.operators.ranking import indexed\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', 'file://{tmp_path}').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"assert indexed(s.range(4), ['id']).count() == 4\nimport os\nassert os.listdir('{tmp_path}')\n"
    )
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    assert list(tmp_path.glob("rollsmith-*")) == []
