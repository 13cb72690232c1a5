import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_training_data_operators(tmp_path):
    """The entry point imports without the llm subpackage and the pipeline."""
    for p in ("__spark_entry__.py", "boxwise"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "boxwise").mkdir()
    for p in (ROOT / "boxwise").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "boxwise" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; {code}"], cwd=tmp_path, check=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "boxwise").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "boxwise").parts:
            assert "boxwise.llm" not in p.read_text()
