"""Every registered query against its SQL at the smallest scale."""

import os
import subprocess
import sys
from glob import glob
from os.path import basename
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.check import rows_of
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        name = basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(contract.oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want and want[1]


AWAY = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from speechprep.session import local_session
spark = local_session(2)
for name in ("audio_decode", "encode_files", "resample", "extract_codes", "map_rows", "line_batch"):
    print(name, len(contract.queries()[name](spark, {sf!r}).collect()))
"""


def test_workers_need_no_installed_package(tmp_path):
    """Tasks carry their functions, also when the driver runs somewhere else."""
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", AWAY.format(repo=repo, sf=SF)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.splitlines()) == 6


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["input_ids", "labels", "attention_mask"] and df.count() > 0
