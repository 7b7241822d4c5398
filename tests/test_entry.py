import importlib.util
import os
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; import tallyhouse.plans.catalog; assert not any('llm' in m for m in sys.modules if m.startswith('tallyhouse'))"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert importlib.util.find_spec("tallyhouse.plans")
