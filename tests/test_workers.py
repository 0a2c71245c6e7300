"""Worker functions must run where the package is not importable."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from tallyveil.functions import special
from tallyveil.operators import panel as P
from tallyveil.session import local_session
spark = local_session("2", 2)
q = spark.range(1).select(special.beta_quantile(0.5, F.lit(2.0), F.lit(2.0))).first()[0]
cells = spark.createDataFrame([(1, 0.0, 0.0)], "cell long, lat double, lon double")
km = P.nearest_distance(cells, spark.createDataFrame([(0.0, 1.0)], "lat double, lon double")).first()["km"]
print(round(q, 6), round(km, 1))
"""


def test_functions_travel_with_the_task(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(repo=repo))
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.strip().endswith("0.5 111.2"), out.stderr[-2000:]
