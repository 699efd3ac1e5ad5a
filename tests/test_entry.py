"""The entry module works with and without the optional subpackage, and hides no error in it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"
    return subprocess.run(
        [sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}
    )


def copy(tmp_path, *left_out):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/turnwise", tmp_path / "turnwise", ignore=shutil.ignore_patterns(*left_out, "__pycache__"))
    return tmp_path


def test_without_the_subpackage(tmp_path):
    said = names(copy(tmp_path, "llm"))
    assert said.returncode == 0 and "vocab_map" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout


def test_errors_inside_the_subpackage_are_seen(tmp_path):
    folder = copy(tmp_path, "llm")
    (folder / "turnwise/llm").mkdir()
    (folder / "turnwise/llm/__init__.py").write_text("")
    (folder / "turnwise/llm/queries.py").write_text("import no_such_module_anywhere\n")
    said = names(folder)
    assert said.returncode != 0 and "no_such_module_anywhere" in said.stderr
