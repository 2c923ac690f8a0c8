import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op8_bpe", "op9_langid"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_path(tmp_path):
    """From another folder, the package being known to the driver alone."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "op8_bpe 200\nop9_langid 200" in done.stdout, done.stderr[-2000:]
