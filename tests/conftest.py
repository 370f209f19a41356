import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cellwise.session import build_session, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def to_records(spark):
    """Python records per split to a record frame (rid, split, replicate, v)."""

    def make(**groups):
        rows, rid = [], 0
        for split, records in groups.items():
            for record in records:
                rows.append((rid, split, 1, json.dumps(record)))
                rid += 1
        df = spark.createDataFrame(rows, "rid bigint, split string, replicate int, doc string")
        return df.select("rid", "split", "replicate", F.parse_json("doc").alias("v"))

    return make
