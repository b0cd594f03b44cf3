import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from relevo.session import get_session

    scratch = tempfile.mkdtemp(prefix="relevo-test-")
    s = get_session("local[*]", 8, app_name="relevo-tests",
                    extra={"spark.local.dir": scratch, "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                           "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from relevo.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
