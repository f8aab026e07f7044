"""Takes this package to the Python workers of an application."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .storage import exists, shared_folder, write_bytes

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def archive() -> bytes:
    """The package's sources as a zip file, the same bytes for the same sources."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(path.relative_to(PACKAGE.parent).as_posix()), path.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Adds the package to the workers' path, once an application; it is fetched from the shared folder, also by executors that start later."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    raw = archive()
    path = f"{shared_folder(spark).rstrip('/')}/vertexloom/code/vertexloom-{hashlib.sha256(raw).hexdigest()[:16]}.zip"
    if not exists(spark, path):
        write_bytes(spark, path, raw)
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
