"""The nearest-neighbour search where Python workers have no copy of the package."""

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp}").getOrCreate()
from weftline.llm import ann
def absent(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("weftline") is None))
print("absent", spark.range(1).mapInPandas(absent, "id long").first()[0])
rows = spark.createDataFrame([(k, [float(k % 17), float(k % 5), float(k)]) for k in range(300)], "vec_id long, embedding array<double>")
print("found", ann.knn(rows, "id % 100 = 0").count())  # row 0 is a zero vector
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), tmp=tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "absent 1" in done.stdout and "found 20" in done.stdout, done.stdout + done.stderr[-2000:]
