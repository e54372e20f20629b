"""Functions travel with their code: the workers need no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path


REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.append({repo!r})
from tidegate.llm.queries import QUERIES
from tidegate.session import build_session
spark = build_session("workers", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "2g"}})

def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("tidegate") is None
    yield from batches

spark.range(1).mapInArrow(absent, "id bigint").collect()
for name in {names!r}:
    assert QUERIES[name](spark, {data!r}).count() > 0, name
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    script = RUN.format(repo=str(REPO), names=["p7_found", "p7_leak_report", "p8_shares", "p9_found"], data=data)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
