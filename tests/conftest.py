import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from quadrille.session import local_session, ship

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-"), "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    ship(session)
    yield session
    session.stop()
