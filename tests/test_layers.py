from __future__ import annotations

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def imports(path: Path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_functions_import_no_operators():
    for path in (ROOT / "quarry/functions").glob("*.py"):
        assert not [m for m in imports(path) if m.startswith(("quarry.operators", "quarry.plans", "quarry.sources"))], path


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert not [m for m in imports(path) if m.startswith("quarry.llm")], path


def test_every_query_has_a_name_in_both():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_folders(tmp_path, pipeline):
    """The entry lists the engine's own queries if the corpus operators are gone, whether or not the pipeline's file still is there."""
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [x for x in q if x.startswith('op') and x[2].isdigit() or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and p != str(ROOT))})
