"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, unless their search path has it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    folder = tempfile.mkdtemp(prefix="triloom-code-")
    path = Path(folder) / "triloom_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((_ROOT / "triloom").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
    return spark
