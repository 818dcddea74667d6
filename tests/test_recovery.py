"""Recovery where folders refuse to be listed, in a process that their modes bind."""

import ctypes
import json
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
from siftline.config import Config
from siftline.operators.embed import HashEmbedder
from siftline.plans.engine import Engine

place, = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", place + "/shared").config("spark.sql.warehouse.dir", place + "/warehouse").getOrCreate()
c = Config()
c.embedder.dimensions, c.instance_id = 8, "here"
e = Engine(spark, place + "/store", c, HashEmbedder(8))
for i, f in {"locked": "/locked/a.txt", "unlisted": "/unlisted/[a] b.txt", "missing": "/unlisted/b.txt", "open": "/open/a.txt", "gone": "/open/b.txt", "below": "/above/a.txt", "nowhere": "/nowhere/a.txt"}.items():
    e.store.create_document(i, "n", f.rsplit("/", 1)[1], "txt", i, place + f, "here")
e.recover()
print(json.dumps({r.id: [r.status, r.error] for r in e.store.documents().collect()}))
"""


def bound():
    """Give up what lets root pass over the modes of files."""
    for right in (1, 2):  # DAC_OVERRIDE, DAC_READ_SEARCH
        ctypes.CDLL(None).prctl(24, right, 0, 0, 0)


def test_folders_that_may_not_be_listed(tmp_path):
    for name, file in (("locked", "a.txt"), ("unlisted", "[a] b.txt"), ("open", "a.txt"), ("above", "a.txt")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text(f"text of {name}")
    (tmp_path / "above" / "lost").mkdir()
    modes = {"locked": 0o000, "unlisted": 0o311, "above/lost": 0o000}
    for name, mode in modes.items():
        os.chmod(tmp_path / name, mode)
    try:
        env = os.environ | {"PYTHONPATH": f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"}
        done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, preexec_fn=bound, capture_output=True, text=True, timeout=300)
    finally:
        for name in modes:
            os.chmod(tmp_path / name, 0o700)
    assert done.returncode == 0, done.stderr[-3000:]
    got = json.loads(done.stdout.splitlines()[-1])
    gone, whole = ["failed", "file not found on disk after restart"], ["completed", None]
    assert got == {"locked": gone, "unlisted": whole, "missing": gone, "open": whole, "gone": gone, "below": whole, "nowhere": gone}
