"""The package's code on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Send the package's code to the executors, once for each application, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_lexweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if (root / "lexweave").is_dir():  # else it was imported from an archive that Spark already sends
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the archive as long as it runs
        shutil.copytree(root / "lexweave", f"{folder}/code/lexweave", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/lexweave", "zip", f"{folder}/code"))
    context._lexweave_shipped = True
