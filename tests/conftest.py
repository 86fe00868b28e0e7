import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from filemason.session import build_session

    session = build_session("filemason-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def file_rows(spark, names, **columns):
    """Files with the given names in order; other columns take constants or lists."""
    import datetime

    from pyspark.sql import functions as F

    from filemason.functions import paths as P

    n = len(names)
    value = lambda key, default: columns.get(key) if isinstance(columns.get(key), list) else [columns.get(key, default)] * n
    rows = list(zip(range(n), [f"/in/{i}/{x}" for i, x in enumerate(names)], value("size", 10),
                    value("modified_at", datetime.datetime(2025, 1, 1)), value("text", "")))
    df = spark.createDataFrame(rows, "seq bigint, path string, size bigint, modified_at timestamp, text string")
    return P.with_path_columns(df).withColumn("created_at", F.col("modified_at")).withColumn("accessed_at", F.col("modified_at"))
