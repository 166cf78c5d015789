"""Small tables with everything that is awkward in them, as fixtures."""

from __future__ import annotations

import pytest
from awkward import CLASHES, COLUMNS, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """docs with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
