"""Session settings and the shared folder for data that outlives a stage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "sensorframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC above all)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # sessions of a busy sensor are merged in each task before they are shuffled
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # call sites per column expression make plan building several times slower
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="sensorframe-")
    return _local_folders[app]
