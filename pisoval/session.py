"""Session settings and the shared checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("pisoval")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.sql.variant.allowDuplicateKeys", "true")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by the cluster; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="pisoval-"))
    return _LOCAL_DIR[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that later actions neither recompute nor depend on one executor."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    folder, store = _store(spark, path)
    return store.exists(folder)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, which need not exist."""
    folder, store = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory()] if store.exists(folder) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more, in whatever store it lies."""
    folder, store = _store(spark, path)
    store.delete(folder, True)


#: Rows of a table that one task values, about.
TASK_ROWS = 50_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks a table's rows make, counted; no fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a frame read in fewer splits than there are cores; a well-split one passes untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
