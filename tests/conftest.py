import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.log.level": "ERROR"}
    conf["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return f"{DATA}/sf0.001"
