"""The package reaches workers that do not find it by themselves; odd texts do not end a job."""

import os
import random
import subprocess
import sys
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from larkspur.functions import jsonx as J
from larkspur.operators import evaluation as V

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").getOrCreate()
from larkspur.functions import jsonx as J
rows = spark.createDataFrame([("x {{a: 1}}",), (None,)], "t string").select(J.relaxed_json(F.col("t")).alias("j")).collect()
print("GOT", [r["j"] for r in rows])
"""


@pytest.mark.parametrize("master", ["local[2]", "local-cluster[2,1,700]"])
def test_workers_get_the_package(master):
    """Run from another folder, with no path to the package but the driver's own."""
    folder = tempfile.mkdtemp(prefix="spark-larkspur-")
    with open(f"{folder}/job.py", "w") as f:
        f.write(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": f"{folder}/work"}
    out = subprocess.run([sys.executable, "job.py", master], cwd=folder, env=env, capture_output=True, text=True, timeout=150)
    assert "GOT ['{\"a\": 1}', None]" in out.stdout, out.stderr[-2000:]


ODD = ["[" * 3000, "[" * 3000 + "]" * 3000, '{"a":"\\ud800"}', '{"a":1e999}', '{"a":NaN}', "{a:'x', 'b': [1,{c:2,},],}", '{"a":[true,null,1.5,-2]} and more', '{"b":"\\ud83d\\ude00"}', "", None, '{"a":', "['a']", "9" * 5000, '{"n":' + "9" * 5000 + "}"]
READ = [None, "[" * 3000 + "]" * 3000, '{"a": "\\ud800"}', '{"a": null}', None, '{"a": "x", "b": [1, {"c": 2}]}', '{"a": [true, null, 1.5, -2]}', '{"b": "😀"}', None, None, None, None, None, None]


def test_odd_json_in_spark(spark):
    got = {r["i"]: r["j"] for r in spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", J.relaxed_json(F.col("t")).alias("j")).collect()}
    assert [got[i] for i in range(len(ODD))] == READ


def test_lcs_equals_table_and_is_fast():
    rng = random.Random(9)
    for _ in range(200):
        u, v = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(v) + 1)
        for x in u:
            new = [0]
            for k, y in enumerate(v):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        assert V.lcs_length(u, v) == row[-1]
    u, v = ([rng.randint(0, 3000) for _ in range(20_000)] for _ in range(2))
    began = time.time()
    V.lcs_length(u, v)
    assert time.time() - began < 5
