"""SparkSession defaults for the library (only set what is unset)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the plans rely on. A cluster's own values win: they are applied
# only where the running session has none.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# The classification fuses a dozen recodes and the maternal predicate into one
# whole-stage-codegen method; HotSpot does not JIT methods above 8000 bytes of
# bytecode unless told to, and an interpreted hot loop is ~5x slower.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "maternis") -> SparkSession:
    """The running session as it is configured, with ``DEFAULTS`` where it sets nothing; else a new
    local/test session: UI off, small shuffle fan-out, AQE on, huge generated methods JIT-compiled."""
    from pyspark import SparkConf
    running = SparkSession.getActiveSession()
    given = running.sparkContext.getConf() if running else SparkConf()
    wanted = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
              "spark.driver.memory": os.environ.get("MATERNIS_DRIVER_MEMORY", "8g"), **DEFAULTS}
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    b = SparkSession.builder
    if running is None:
        b = b.appName(app_name)
        for k in ("spark.driver.extraJavaOptions", "spark.executor.extraJavaOptions"):  # added to, not replaced
            b = b.config(k, f"{given.get(k, '')} {JVM_OPTIONS}".strip())
        if master:
            b = b.master(master)
        for k, v in wanted.items():
            if not given.contains(k):
                b = b.config(k, v)
    else:
        overridden = set(running.conf.getAll)
        for k, v in DEFAULTS.items():
            if k not in overridden and not given.contains(k):
                running.conf.set(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is given by the cluster's configuration and is
    used as is. Only when it is unset (local runs, tests) a scratch folder is
    created here.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master  # local-cluster[...] has executors of its own
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage "
                             "(a machine-local folder does not survive a lost executor)")
        d = tempfile.mkdtemp(prefix="maternis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
