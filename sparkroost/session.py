"""Session settings, and shipping this package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def create(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that this engine expects (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName("sparkroost")
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application. Spark serves the archive from the
    driver; nothing is read from the driver's folders by executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkroost-code-")) / "sparkroost-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for a query's intermediate files, the same one at each call: in spark.checkpoint.dir;
    on a local master without that setting in a temporary folder that goes with the process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local" not in _folders:
            _folders["local"] = tempfile.mkdtemp(prefix="sparkroost-")
            atexit.register(shutil.rmtree, _folders["local"], ignore_errors=True)
        shared = "file://" + _folders["local"]
    return f"{shared.rstrip('/')}/sparkroost-{context.applicationId}/{name}"
