"""Sessions for tests and benches, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session as the tests and bench.py use it."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("quadrille").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, through Spark's file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    to = os.path.join(tempfile.mkdtemp(prefix="spark-quadrille-"), "quadrille_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    spark.sparkContext.addPyFile(to)
