"""What executors need of a session: the package itself."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to Spark's Python workers, once in an application, so that they can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or ROOT.suffix == ".zip" or not ROOT.is_dir():
        return
    at = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, Path("quern") / f.relative_to(ROOT))
    context.addPyFile(str(at))
    _SHIPPED.add(context.applicationId)
