"""Session settings and the shared folder that staged tables are written to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on; sizes are left to the cluster's own defaults.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_folders: dict[str, str] = {}
_to_remove: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seaplate")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used in local mode only;
    on a cluster such a folder would be lost with its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="seaplate-")
    return _local_folders[app]


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_folder(spark)}/seaplate/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table in the application's folder, which is removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _to_remove:
        _to_remove.add(app)
        atexit.register(_remove_at_exit, spark)
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> bool:
    """Delete everything this application has staged; frames that read it cannot be used any more.

    The folder in ``spark.checkpoint.dir`` belongs to the cluster's operator; below it an application
    writes to, and removes, nothing but its own folder.
    """
    return remove_path(spark, run_folder(spark))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete one staged path, wherever Spark can write."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _remove_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped, and the operator's clean-up is left
        remove_staged(spark)
