import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def alone(folder):
    """The environment with the folder first on the path, and what the driver has put there after it."""
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), *filter(None, [os.environ.get("PYTHONPATH")])])}


def test_every_operator_has_one_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_library_stands_without_the_subpackage(tmp_path):
    for x in ("bibliarium", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{x}") else shutil.copy)(f"{REPO}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "bibliarium/llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env=alone(tmp_path), capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"] and int(said.stdout.split()[0]) > 40, said.stderr
    shutil.copytree(f"{REPO}/tests", tmp_path / "tests")
    shutil.rmtree(tmp_path / "tests/llm")
    # every test can be loaded, and those that need little time pass; all of them run with the subpackage there, too
    for how in (["--collect-only"], ["-x", "-k", "scalar or doi or entry or ends_inside or bibtex or validation"]):
        ran = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", *how], cwd=tmp_path, env=alone(tmp_path), capture_output=True, text=True)
        assert ran.returncode == 0, ran.stdout[-2000:]


def test_what_else_is_missing_is_an_error(tmp_path):
    for x in ("bibliarium", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{x}") else shutil.copy)(f"{REPO}/{x}", tmp_path / x)
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=alone(tmp_path), capture_output=True, text=True)
    assert said.returncode and "not here" in said.stderr
