"""The entry module, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, *rest):
        if name.startswith("tideline.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
"""


def test_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "tideline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
