import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import spark_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Bound groups so low that every operator has to cut them into blocks."""
    from rankloom.plans.groups import GROUP_LIMIT_KEY

    spark.conf.set(GROUP_LIMIT_KEY, "7")
    yield spark
    spark.conf.unset(GROUP_LIMIT_KEY)


@pytest.fixture(scope="session")
def toy(spark):
    """Two judged lists of two and three documents."""
    rows = [
        (1, 0, 1.0, 0.5), (1, 1, 0.0, -0.2),
        (2, 0, 1.0, 0.3), (2, 1, 1.0, 1.2), (2, 2, 0.0, 0.1),
    ]
    return spark.createDataFrame(rows, "query_id long, pos int, label double, logit double")


def ranked_lists(spark, *lists):
    """Lists of labels in ranked order as judgments."""
    rows = [
        (q, i, float(label), -float(i))
        for q, labels in enumerate(lists) for i, label in enumerate(labels)
    ]
    return spark.createDataFrame(rows, "query_id long, doc_id long, label double, score double")


def only(df):
    """The single value of a one-row, one-column table."""
    row = df.collect()
    assert len(row) == 1 and len(row[0]) == 1
    return row[0][0]


def values(df, column):
    """The column by query."""
    return [row[column] for row in df.orderBy("query_id").collect()]
