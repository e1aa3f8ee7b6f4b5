"""The entry file in copies of the repository that lack the training-data operators, their pipeline, or both."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') for n in q), 'pipeline' in q, set(o) <= set(q))"


def listed(place):
    done = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=place, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(place)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/buildlore", tmp_path / "buildlore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from buildlore.llm import quality\n")
    count, oracles, *rest = listed(tmp_path)
    assert int(count) >= 149 and int(oracles) >= 140 and rest == ["False", "False", "True"]


def test_without_the_pipeline_alone(tmp_path):
    if not os.path.isdir(f"{ROOT}/buildlore/llm"):
        pytest.skip("not installed")
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/buildlore", tmp_path / "buildlore", ignore=shutil.ignore_patterns("__pycache__"))
    assert listed(tmp_path)[2:] == ["True", "False", "True"]
