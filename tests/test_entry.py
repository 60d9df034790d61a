"""The driver's contract, also without the training-data subpackage."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_library_does_not_import_llm():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
