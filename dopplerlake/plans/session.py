"""Getting the package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers once, so that it need not be installed there."""
    context = spark.sparkContext
    if not getattr(context, "_dopplerlake_shipped", False):
        root = Path(__file__).resolve().parents[1]
        handle, name = tempfile.mkstemp(prefix="dopplerlake-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(name)
        context._dopplerlake_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder of this machine serves,
    but only if the tasks run in this process: elsewhere it would be a folder of each executor's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="dopplerlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found
