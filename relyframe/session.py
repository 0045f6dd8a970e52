"""SparkSession construction and the shared scratch location.

On a cluster the shared folder comes from ``spark.checkpoint.dir``; a
private folder is created only when that setting is absent (tests, local
runs).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "relyframe") -> SparkSession:
    """The running session, the submitted one, or a local one.

    Under spark-submit the master, memory and partitions stay as submitted;
    laptop settings are for plain python. The time zone is pinned: results depend on it.
    """
    conf = {"spark.sql.session.timeZone": "UTC"}
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # else spark-submit started the driver, with its own settings
        conf |= {"spark.master": master or os.environ.get("RELYFRAME_MASTER", "local[8]"), "spark.ui.enabled": "false",
                 "spark.ui.showConsoleProgress": "false",
                 "spark.driver.memory": os.environ.get("RELYFRAME_DRIVER_MEMORY", "16g"),
                 "spark.sql.shuffle.partitions": os.environ.get("RELYFRAME_SHUFFLE_PARTITIONS", "8")}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it, wherever it was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) a private folder is created and registered.
    """
    importable(spark)
    # let AQE coalesce the output of persisted frames too
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: executors of local-cluster are processes of their own")
        conf_dir = tempfile.mkdtemp(prefix="relyframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def own_checkpoints(spark: SparkSession):
    """Checkpoints made inside lie in a folder of their own, which is deleted at the end, and shuffles that nothing refers to are dropped.

    What comes of them must have been collected by then.
    """
    base, sc = scratch_path(spark, "own"), spark.sparkContext._jsc.sc()
    before = sc.checkpointDir()
    sc.setCheckpointDir(base)
    try:
        yield
    finally:
        getattr(sc, "checkpointDir_$eq")(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()
