"""A part of the registered queries beside their SQL; check_oracles.py runs all."""

import subprocess
import sys
from pathlib import Path

import pytest
from check_oracles import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from logfathom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["syslog5424", "cef", "leef_delimiters", "access_log", "json_records", "zeek_conn", "stats_report",
         "insert_ignore", "es_bulk", "stix_observed", "filter_all", "detect_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, text = compare(queries()[name](spark, SF), duck(SF), oracle_sql()[name])
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 1


def test_entry_without_the_optional_part():
    """The entry imports, with all other queries, where the operators for
    training data cannot be found, whether the pipeline's file is there or not."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("logfathom.llm"):
            raise ModuleNotFoundError(name)
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("logfathom.llm") else real(name, package)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from logfathom.plans.catalog import QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES)
"""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
