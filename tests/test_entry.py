"""The entry module with and without the parts that can be deleted."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print('NAMES', *sorted(q))"


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.rpartition("NAMES")[2].split())


def copy_without(tmp_path, *parts):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for part in parts:
        path = tmp_path / "copy" / part
        (shutil.rmtree if path.is_dir() else os.remove)(path)
    return tmp_path / "copy"


def test_entry_without_llm_folders(tmp_path):
    folder = copy_without(tmp_path, *(p for p in ("leafmill/llm", "tests/llm") if os.path.exists(os.path.join(REPO, p))))
    left = names(folder)
    assert "bm25_topk" in left and "pipeline" not in left and not any(n.startswith("op") and n[2].isdigit() for n in left)


def test_entry_without_pipeline_too(tmp_path):
    gone = [p for p in ("leafmill/llm", "tests/llm", "corpus_pipeline.py") if os.path.exists(os.path.join(REPO, p))]
    assert "bm25_topk" in names(copy_without(tmp_path, *gone))


def test_other_import_errors_are_not_hidden(tmp_path):
    folder = copy_without(tmp_path)
    with open(folder / "corpus_pipeline.py", "w") as file:
        file.write("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode and "no_such_module" in said.stderr
