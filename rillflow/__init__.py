"""rillflow: a Spark-first engine for the data side of language-model post-training."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package to the Python workers of a session's executors, once a session; where it is installed on them, there is no need to.

    The driver packs it and Spark serves the file, so nothing has to be shared or installed.
    """
    if getattr(spark, "_rillflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="rillflow-")) / "rillflow.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    spark._rillflow_shipped = True
