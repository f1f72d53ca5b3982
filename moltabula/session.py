"""Session settings for local runs, and sending this package to the Python workers of any session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "moltabula") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package, wherever they run; once per application.

    The archive is made on the driver, and Spark hands it to every executor.
    """
    context = spark.sparkContext
    if not getattr(context, "_moltabula_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="moltabula-package-"), "moltabula")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._moltabula_shipped = True
    return spark
