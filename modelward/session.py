"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "modelward", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MODELWARD_DRIVER_MEMORY", "12g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, where driver and executors share the disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="modelward-")
    return _LOCAL_ROOTS[app]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the shared folder (nothing is created yet)."""
    return f"{shared_root(spark)}/{purpose}/{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder when the session has not done so."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python once per application, for clusters where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="modelward-code-")
        for base, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    to = os.path.join(folder, "code", os.path.relpath(base, os.path.dirname(package)))
                    os.makedirs(to, exist_ok=True)
                    shutil.copy(os.path.join(base, name), to)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "modelward_code"), "zip", os.path.join(folder, "code")))
        _SHIPPED.add(sc.applicationId)
