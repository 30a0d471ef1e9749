"""The driver contract: names, schemas, and SQL on the smallest tables where they are there."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    if importlib.util.find_spec("pixelyard.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None:
        assert "pipeline" in queries and {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_operators(tmp_path, also):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and not any(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["match_t50", "coco_summary_12", "panoptic_pq", "tide_bins"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    ours = entry.queries()[name](spark, DATA).toPandas()
    theirs = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (ours.round(6), theirs.round(6)))
    assert (a == b).all().all()
