"""What workers of a session that knows nothing of the package's folder are sent."""

import os
import subprocess
import sys

from pyspark import SparkFiles

from bookloom.shipping import ship

PROGRAM = """
import bookloom
from bookloom.operators import fuzzy
from bookloom.functions import text
print("FROM", bookloom.__file__)
print("SCORE", fuzzy.token_set_score("pat quill", "quill pat"))
"""


def test_the_archive_alone_is_the_package(spark, tmp_path):
    ship(spark)
    archive = SparkFiles.get("bookloom.zip")
    out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env={**os.environ, "PYTHONPATH": archive},
                         capture_output=True, text=True, timeout=120)
    assert f"FROM {archive}" in out.stdout and "SCORE 100.0" in out.stdout, out.stdout + out.stderr


def test_workers_get_the_archive(spark):
    ship(spark)

    def paths(batches):
        import sys
        for b in batches:
            yield b.assign(found=any(p.endswith("bookloom.zip") for p in sys.path))
    got = spark.range(8).repartition(2).mapInPandas(paths, "id long, found boolean")
    assert {r["found"] for r in got.collect()} == {True}
