"""Shipping the package and removing scratch tables."""

import os
import subprocess
import sys
import time

from pyspark.sql import functions as F

from breezeway.session import discard, materialise, shuffles_go

ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
from breezeway.session import ship
ship(spark)
sys.path.remove({root!r})

def where(batches):
    import breezeway
    for b in batches:
        yield b.assign(at=breezeway.__file__)

print("FOUND", spark.range(1).mapInPandas(where, "id long, at string").first().at)
"""


def test_shipped_package_is_found_outside_the_repository(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ALONE.format(root=root, folder=str(tmp_path / "shared"))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    found = [line for line in out.stdout.splitlines() if line.startswith("FOUND")]
    assert found and "breezeway.zip" in found[0], out.stderr[-2000:]


def test_discarded_tables_are_gone_and_others_stay(spark):
    a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
    plain = spark.range(2)
    discard(a, plain)
    assert not os.path.exists(a._scratch) and b.count() == 4 and plain.agg(F.count("id")).first()[0] == 2


def test_shuffle_files_of_a_written_table_are_gone(spark):
    name, files = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark._jvm.org.apache.spark.SparkEnv.get()
    before = spark.conf.get(name, None)

    def kept():
        folders = files.blockManager().diskBlockManager().localDirs()
        return {x for folder in folders for _, _, names in os.walk(folder.getPath()) for x in names if x.startswith("shuffle_")}

    there = kept()
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = materialise(rows, "rows")
    for _ in range(50):  # they go in the background
        if kept() <= there:
            break
        time.sleep(0.1)
    assert kept() <= there
    assert sum(r["count"] for r in table.collect()) == 1000
    assert rows.count() == 7 and spark.conf.get(name, None) == before
    with shuffles_go(spark):
        assert spark.conf.get(name) == "true"
    discard(table)
