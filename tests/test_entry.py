import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).parent.parent


def test_entry_has_rows(spark, sf_dir):
    assert e.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    """What is left after the removal still imports, also where an empty folder stays behind."""
    import shutil

    shutil.copytree(ROOT / "nearfield", tmp_path / "nearfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'knn_exact_l2' in e.queries() and not [x for x in e.queries() if x.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "nearfield" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_library_does_not_import_the_subpackage():
    for p in (ROOT / "nearfield").rglob("*.py"):
        if "llm" not in p.parts:
            assert "nearfield.llm" not in p.read_text(), p
