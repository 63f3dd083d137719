"""Scratch tables, and workers that find the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from skein import workspace
from skein.sources.fs import Files


def test_scratch_tables_are_freed(spark):
    kept = workspace.materialise(spark.range(3), "kept")
    with workspace.freeing():
        inside = workspace.materialise(kept, "inside")
        path = inside.inputFiles()[0]
        assert inside.count() == 3 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session)


def test_parts_are_joined_in_order(spark, tmp_path):
    folder, path = str(tmp_path / "parts"), str(tmp_path / "one.txt")
    spark.range(1000).repartition(5).orderBy("id").selectExpr("cast(id as string)").write.text(folder)
    Files(spark).join(folder, path)
    assert Path(path).read_text().split() == [str(i) for i in range(1000)]
    spark.range(0).selectExpr("cast(id as string)").write.text(folder + "0")
    Files(spark).join(folder + "0", path)
    assert Path(path).read_text() == "\n"


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = str(Path(workspace.__file__).resolve().parent.parent)
    script = tmp_path / "go.py"
    script.write_text(f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
from skein import build_graph
from skein.schema import FILES
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print("found", sorted(r["id"] for r in build_graph(spark.createDataFrame([(1, "p", "a.py", ".py", "python", "def f(): pass")], FILES)).nodes.collect()))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "found ['a.py', 'a.py::f']" in out.stdout, out.stderr[-2000:]
