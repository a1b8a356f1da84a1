"""Every query against its SQL on the driver's smallest tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

from probatum.operators import signal
from probatum.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in catalog.SQL:
        expected = con.sql(catalog.SQL[name])
        at = [got.columns.index(c) for c in expected.columns]
        assert sorted(got.columns) == sorted(expected.columns)
        assert plain(tuple(r[i] for i in at) for r in rows) == plain(expected.fetchall())


def test_golden_signal(spark):
    row = catalog.QUERIES["golden_signal"](spark, SF).first()
    assert (row["channel"], row["latency_ms"]) == ("MEG1", 100)


def test_a_made_up_recording_is_judged(spark):
    rows = signal.baseline_corrected(signal.epochs(*signal.synthetic(spark))).withColumn("lag", F.round("lag", 6))
    row = signal.peak(signal.averaged(rows, 0.001), 30, 235).first()
    assert (row["channel"], row["lag_step"], row["n"]) == ("MEG1", 100, 40)


def test_entry_without_the_training_data_operators(tmp_path):
    """The driver deletes those folders; the rest must import and list its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "probatum", tmp_path / "probatum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]
