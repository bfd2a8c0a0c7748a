import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(root, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_corpus_operators(tmp_path):
    """With the folders of the corpus operators deleted, with and without the pipeline's file, the others stay."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    whole = run(ROOT, code) if os.path.isdir(f"{ROOT}/flowspark/llm") else None
    for k, gone in enumerate((["flowspark/llm", "tests/llm"], ["flowspark/llm", "tests/llm", "corpus_pipeline.py"])):
        copy = tmp_path / str(k)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for name in gone:
            path = copy / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        names = run(copy, code)
        assert "pkt_counter" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
        if whole:
            assert {n for n in whole if n not in names} == {n for n in whole if n.startswith("op") or n == "pipeline"}
