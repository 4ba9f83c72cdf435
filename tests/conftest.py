import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfscope.session import checkpoint_dir, get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", app_name="shelfscope-tests",
                          conf={"spark.sql.shuffle.partitions": "4"})
    # tests only: a local checkpoint folder when the session names none
    checkpoint_dir(session, tempfile.mkdtemp(prefix="shelfscope-ckpt-"))
    yield session
    session.stop()


def rows(df, *cols):
    """Collected rows as plain tuples (selected columns, in order)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
