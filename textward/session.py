"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: State stores of the streaming jobs keep keyed values, lists and timers; a cluster's session needs it too.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
DEFAULTS = STATE_STORE | {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "8", app: str = "textward") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("TEXTWARD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in a local session without one."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textward-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame several later branches read to the shared folder, once, and read it back.

    Unlike a cache it survives executor loss, and the work above it runs a single time.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder.rstrip('/')}/textward-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*frames: DataFrame) -> None:
    """Delete the written tables of cut_lineage() behind these frames, whose readers have all been written.

    Also lets the driver notice that shuffles of finished steps are unused, so that executors drop their files now
    and not at the next collection of a driver with much memory.
    """
    spark = None
    for frame in frames:
        spark = frame.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("textward-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()
