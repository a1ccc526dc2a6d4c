import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pvlens.session import get_spark
    # tests own their session, so they set the checkpoint folder themselves
    s = get_spark(master="local[*]", app="pvlens-tests", shuffle_partitions=8,
                  **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pvlens-test-ckpt-"),
                     "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *cols):
    """Collect ``cols`` of ``df`` as a list of tuples (or scalars for one column)."""
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return [r[0] for r in out] if len(cols) == 1 else out
