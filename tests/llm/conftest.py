import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers inherit the environment, not sys.path
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        """(doc_id, text) rows; with extra columns whose names the operators use inside."""
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            for name in ("id", "n", "a", "b", "_key", "_text", "group", "task", "signature", "score", "label", "at", "start"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
