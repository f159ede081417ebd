import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import build_session, checkpoint_root
    s = build_session("local[4]", app="ledgerlake-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    checkpoint_root(s)  # tests: no cluster-provided folder, use a private temp one
    yield s
    s.stop()
