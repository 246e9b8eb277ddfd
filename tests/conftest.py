import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from glossa.session import get_spark

    s = get_spark("local[4]", 4, app_name="glossa-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test tables not present")
    return SF_SMALL


@pytest.fixture
def tiny(spark):
    """20 labelled rows: 10 sarcastic, 10 literal, two registers."""
    rows = []
    for i in range(10):
        rows.append((i, f"oh great another monday {i} #sarcasm", 1, "s", "en-IN"))
        rows.append((100 + i, f"the meeting is at ten {i}", 0, "s", "hi-en" if i % 2 else "en-IN"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label bigint, source string, "
                                       "language_register string")
