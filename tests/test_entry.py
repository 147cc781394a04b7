"""The driver contract with and without the optional text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(before: str) -> set[str]:
    code = before + "\nimport __spark_entry__ as e\nprint('NAMES', *e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return set(out.stdout.rpartition("NAMES")[2].split())


def test_the_rest_imports_without_the_text_operators():
    hide = """
import importlib.util
real = importlib.util.find_spec
def find_spec(name, package=None):
    return None if name.startswith("riskledger.llm") else real(name, package)
importlib.util.find_spec = find_spec
import sys
sys.modules["riskledger.llm"] = None
"""
    left = names(hide)
    assert "risk_queue" in left and "pipeline" not in left and not any(x.startswith("op") and x[2:3].isdigit() for x in left)


@pytest.mark.skipif(not (ROOT / "riskledger" / "llm").is_dir(), reason="the text operators are not here")
def test_the_text_operators_are_added():
    assert {"pipeline", "op1_html", "risk_queue"} <= names("")
