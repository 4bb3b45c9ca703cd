"""The entry point imports without a Spark session, and names what it should."""

import subprocess
import sys

from .conftest import ROOT


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
