"""The entry module without the optional subpackage, without a library of it, and with an empty folder left of it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PART = "kinelake/" + "llm"


def names(folder, before=""):
    code = f"{before}\nimport __spark_entry__ as e\nprint(*sorted(e.queries()))\nprint(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout
    return [set(line.split()) for line in out.splitlines()[-2:]]


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(f"{ROOT}/kinelake", tmp_path / "kinelake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    return tmp_path


def test_without_the_optional_part(copy):
    rest, sql = names(copy, "import sys; sys.modules['ahocorasick'] = None")
    assert len(rest) > 100 and sql == rest and not any(n.startswith("op") for n in rest)
    shutil.rmtree(copy / PART, ignore_errors=True)
    assert names(copy)[0] == rest
    os.makedirs(copy / PART / "__pycache__")
    assert names(copy)[0] == rest
    shutil.rmtree(copy / PART)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(copy)[0] == rest
