"""Session factory for local runs; on a cluster the caller passes its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session, once; for clusters on whose nodes it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="epistrata-"), "epistrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "epistrata").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "epistrata") -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    n = cpus or os.cpu_count() or 4
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) not in paths:  # Python workers import the package from wherever the session was started
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in [str(ROOT), *paths] if p)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
