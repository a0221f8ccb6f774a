import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p3_found", "p4_found", "p6_found"} <= set(e.queries())


def test_the_rest_does_not_need_the_subpackage():
    code = "import sys; sys.modules['kinloom.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_nothing_outside_imports_the_subpackage():
    for f in (ROOT / "kinloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "kinloom").parts:
            assert "kinloom.llm" not in f.read_text(), f
