import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import get_spark
    s = get_spark("local[4]", 8, app="ledgerline-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ll-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="ll-test-out-")


def pages_df(spark, rows):
    """rows: list of (vendor, file, page_idx, text)."""
    from ledgerline.functions.schema import PAGES_SCHEMA
    return spark.createDataFrame(rows, PAGES_SCHEMA)
