import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from codelake.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "codelake-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def files_of(spark):
    """File rows from {path: text}; the language follows from the path."""
    from pyspark.sql import functions as F

    from codelake.functions.paths import detect_language

    def make(texts, repo="r"):
        rows = [(repo, path, text) for path, text in texts.items()]
        frame = spark.createDataFrame(rows, "repo string, path string, content string")
        return frame.withColumn("language", detect_language(F.col("path")))

    return make
