"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by
``spark.checkpoint.dir``; it is only invented (under the system temp folder)
when the session has none, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a union that keeps its children's partitioning has lost rows behind a filter (4.1)
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep broadcast decisions explicit: only fit tables of known size are hinted
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "tidewatch", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TIDEWATCH_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tidewatch-ckpt-")  # one process: its own folder is shared
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared scratch folder for a written table."""
    import uuid
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as Parquet under the shared scratch folder and read it
    back: the plan runs exactly once (an eager ``checkpoint()`` computes it
    and then recomputes it to write), lineage is cut, and a lost executor only
    costs re-reading files."""
    path = new_scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def clean_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application's ``materialize`` calls have
    written; call it when no result that reads them is needed any more.
    Returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewatch`` importable in the executors' Python workers (pandas
    UDFs and grouped-map functions refer to its modules): the package is zipped
    on the driver and distributed by Spark with ``addPyFile``, once per
    application, whatever the working directory or cluster layout."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import tidewatch
    pkg = os.path.dirname(os.path.abspath(tidewatch.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="tidewatch-pkg-"), "tidewatch.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
