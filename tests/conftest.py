import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from linesift.session import local_session

    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    s = local_session(4, shuffle_partitions=8, checkpoint_dir=os.path.join(scratch, "checkpoints"))
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return tmp_path


def segments_of(spark, rows):
    """[(file_path, text)] -> line segments."""
    from linesift.sources.tables import corpus_segments

    return corpus_segments(spark.createDataFrame(rows, "file_path string, text string"))
