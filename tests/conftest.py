import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def files_table(spark):
    """Make a files table of {path: content} for one repository."""
    from codeaudit.sources.files import with_names

    def make(contents, repo="r"):
        rows = [(repo, p, c) for p, c in contents.items()]
        return with_names(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    return make
