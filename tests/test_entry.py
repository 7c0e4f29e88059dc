"""The driver contract, with and without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm():
    code = "import sys; sys.modules['terrace.llm'] = None\nimport __spark_entry__ as e\nassert 'pricing_summary' in e.queries() and not any(k.startswith('op') for k in e.queries() if k[2:3].isdigit())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
