import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
NOW = 1_704_067_200_000


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """Records from dicts, defaults filled in."""
    from memlake.schema import make_records

    def make(*items, now=NOW):
        names = {
            "id": "string", "kind": "string", "text": "string", "origin": "string", "subject": "string", "field": "string", "value": "string", "status": "string", "confidence": "double", "importance": "double", "pinned": "boolean",
            "observedAt": "bigint", "lastUsedAt": "bigint", "tags": "array<string>", "supersedes": "array<string>", "supersededBy": "string", "facet": "string", "branch": "string", "scope": "struct<level:string,key:string>", "useCount": "bigint",
            "reinforcement": "struct<sessions:array<string>,count:bigint>", "refs": "array<struct<sessionId:string,from:bigint,to:bigint,via:string>>",
        }
        data = [tuple(item.get(n) for n in names) for item in items]
        return make_records(spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in names.items())), now)

    return make
