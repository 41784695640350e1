"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf keys a caller may override; nothing here depends on the size of the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", app: str = "tidewire", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        # Small test data: keep all cores busy instead of merging it into one partition.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``.

    The session's own setting wins. Only where it is unset (tests, a laptop) is a fresh local
    folder made, and only when the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="tidewire-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a costly intermediate to the shared folder and go on from the written table.

    Later steps that read it several times do not run its plan again, and a lost executor costs
    a re-read instead of a re-run. ``compression`` names a Parquet codec other than the session's.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Folders that ``materialise`` has written in this process.
_WRITTEN: list[str] = []


def discard_materialised(spark: SparkSession, after: int = 0, before: int | None = None) -> int:
    """Remove what ``materialise`` has written since the process had written ``after`` folders.

    With ``before`` given, only the folders written up to that mark go, and later ones move up in
    the count. Call it once results are stored: frames that read the intermediates no longer work.
    Returns how many folders went. ``written_so_far`` gives the marks to pass.
    """
    gone = _WRITTEN[after:before]
    configuration = spark._jsc.hadoopConfiguration()
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(configuration).delete(where, True)
    del _WRITTEN[after:before]
    return len(gone)


def written_so_far() -> int:
    return len(_WRITTEN)
