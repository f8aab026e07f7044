import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import vertexloom
from vertexloom.functions.shipping import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)
def where(batches):
    import pyarrow as pa
    from vertexloom import errors
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([errors.__file__] * b.num_rows)], ["file"])
print("FOUND", spark.range(1).mapInArrow(where, "file string").first()[0])
"""


def test_workers_find_the_package_wherever_the_driver_starts(tmp_path):
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "FOUND" in said.stdout, said.stderr[-2000:]
    assert ".zip" in said.stdout
