"""Every registered query gives the rows of its SQL; the few that SQL cannot express have a test of their own."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.abspath(__file__))
QUERIES, SQL = entry.queries(), entry.oracle_sql()

# Queries without SQL and the file that tests them against brute force, a round trip or held-out accuracy.
WITHOUT_SQL = {
    "op1_toxicity": "llm/test_models.py",
    "op2_language_id": "llm/test_models.py",
    "op3_lm_score": "llm/test_lm_score.py",
    "op5_decontamination": "llm/test_decontaminate.py",
    "op6_substring_dedup": "llm/test_substring.py",
    "op7_simhash_near_dedup": "llm/test_simhash.py",
    "op8_token_files": "llm/test_token_files.py",
    "op9_secret_scan": "llm/test_secrets.py",
    "pipeline": "llm/test_pipeline.py",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    got = check_oracle._digest(QUERIES[name](spark, SF).toArrow())
    want = check_oracle._digest(duck.sql(SQL[name]).to_arrow_table())
    assert got == want


def test_queries_without_sql_are_tested_elsewhere():
    bare = set(QUERIES) - set(SQL)
    assert bare <= set(WITHOUT_SQL)
    assert all(os.path.exists(f"{HERE}/{WITHOUT_SQL[name]}") for name in bare)


@pytest.mark.parametrize("pipeline", [False, True])
def test_rest_stands_without_the_training_data_operators(tmp_path, pipeline):
    """A copy without the subpackage, its tests and (in one case) the pipeline imports and keeps all other queries."""
    root = os.path.dirname(HERE)
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, f"{tmp_path}/copy", ignore=left_out)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=f"{tmp_path}/copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
