"""Session helpers: one place for the settings every plan relies on.

Time zone and ANSI casts are set on the session, because results depend on
them; the performance switches are only filled in where they are unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library's semantics depend on (UTC wall clock, ANSI casts,
# adaptive execution for runtime re-planning of joins and skew).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "hourglass") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffle count)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings to an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled",
                 "spark.sql.adaptive.skewJoin.enabled"):
            # performance switches: respect an explicit cluster choice
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
            continue
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is (unset on a cluster is an error).  Only a local-mode session without
    one (tests) gets a scratch folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: a machine-local folder "
                               "is not visible to every executor")
        d = tempfile.mkdtemp(prefix="hourglass-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new unique folder under the shared checkpoint folder, remembered for :func:`release_scratch`."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/hourglass-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process wrote (only those), through the Hadoop file system.

    Call it when no DataFrame reading them is needed any more; returns how
    many folders were removed.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.delete(path, True):
            removed += 1
    return removed


def materialize(df, name: str = "table"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where a derived table feeds several branches of a plan: it is
    computed once, the lineage is cut (a lost executor re-reads files instead
    of recomputing upstream shuffles), and later reads get column pruning and
    filter pushdown that an RDD checkpoint would not give.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
