import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    b = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").appName("tests").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", str(place / "shared")).config("spark.sql.warehouse.dir", str(place / "warehouse"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples."""

    def read(df, *columns):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(found, key=repr)

    return read
