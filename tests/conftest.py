import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).parent.parent)).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(_zipped(folder))
    yield session
    session.stop()


def _zipped(folder: str) -> str:
    """The package as a file that Python workers import, wherever the tests are started."""
    import shutil

    return shutil.make_archive(f"{folder}/casewright", "zip", Path(__file__).parent.parent, "casewright")
