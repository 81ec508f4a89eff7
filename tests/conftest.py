from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over rows of text."""

    def run(fn, rows, schema="v STRING"):
        from pyspark.sql import functions as F

        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"i INT, {schema}").repartition(3)
        names = [c for c in df.columns if c != "i"]
        out = df.select("i", fn(*[F.col(c) for c in names]).alias("r"))
        return [r.r for r in sorted(out.collect(), key=lambda r: r.i)]

    return run
