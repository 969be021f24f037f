import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.enabled=false pyspark-shell")

for folder in (Path(__file__).resolve().parent, Path(__file__).resolve().parent.parent):
    sys.path.insert(0, str(folder))

from rallyline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", 2, "rallyline-tests")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
