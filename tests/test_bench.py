from __future__ import annotations

import importlib
import json
import os
import subprocess
import sys

from tests.conftest import ROOT
from tests.tables import sf_dir


def test_prints_one_json_line(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR=sf_dir("0.001"), BENCH_CPUS="2", BENCH_REPEATS="1", BENCH_MEMORY="2g")
    done = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=True,
    )
    (text,) = done.stdout.splitlines()
    line = json.loads(text)
    assert set(line) == {"metric", "value", "unit", "queries", "sf"}
    assert set(line["queries"]) == set(importlib.import_module("__spark_entry__").queries())
    assert "pricing_summary: " in done.stderr and " until the last job begins" in done.stderr
    assert line["unit"] == "sec" and line["sf"] == 0.001 and line["value"] > 0
