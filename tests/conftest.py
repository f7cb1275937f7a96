import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").appName("tidelint-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s


@pytest.fixture(params=["whole", "split"])
def layout(request, spark):
    """Every scan must give the same rows whole or cut into pieces."""
    if request.param == "split":
        spark.conf.set("spark.tidelint.pieceRows", "16")
    yield request.param
    spark.conf.unset("spark.tidelint.pieceRows")
