"""What every part needs from the session: shipping this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once a session, so that Python workers import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="codeloom-")) / "codeloom_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(Path(PACKAGE.name) / f.relative_to(PACKAGE)))
    sc.addPyFile(str(archive))
    sc._codeloom_shipped = True
