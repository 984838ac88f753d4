"""Session building, checkpoint folder and shipping of the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "leakgauge", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of this process serves a local master (tests, a
    laptop); on a cluster that is an error, as executors would write to disks
    of their own.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and sc.getCheckpointDir() is None and not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="leakgauge-checkpoint-"))
    return given or sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    ``spark.checkpoint.dir`` is honoured when the session has it; only where it
    is unset (tests, a laptop) a folder of this process is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, so that Python workers import it by name.

    Spark's own file server distributes the archive; nothing is read from a
    machine-local folder of an executor by path.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_leakgauge_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="leakgauge-ship-")) / "leakgauge_package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(_PACKAGE.rglob("*.py")):
                archive.write(path, f"leakgauge/{path.relative_to(_PACKAGE)}")
        sc.addPyFile(str(target))
        sc._leakgauge_shipped = True
    return spark
