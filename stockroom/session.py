"""Session construction and the few cluster settings every job reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that decide results (not only speed): times are compared as
# naive UTC wall-clock values, exactly as the source tables store them.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# A hot key is split even where that costs one more shuffle (a join feeding an
# aggregate on the same key): one key may hold a third of the rows. Every query
# runs with it, whoever built the session.
SKEW_CONF = {
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Settings for speed at scale. AQE re-plans joins and coalesces/splits
# shuffle partitions at run time; skew join splits a hot key's partition.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    **SKEW_CONF,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcast only small sides; dimension tables of this model (stores,
    # categories, roles) are far below this, fact tables never are.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # streaming state (running stock per product) off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stockroom") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**SCALE_CONF, **RESULT_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply the runtime-settable scale settings (``spark.sql.*``) to an existing
    session. Sizes (broadcast, partitions) and the state store are the cluster
    launcher's choice, so no query calls this; a launcher may."""
    for k, v in SCALE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    apply_result_conf(spark)


def apply_result_conf(spark: SparkSession) -> None:
    """Pin the settings every query relies on, on a session we did not build."""
    for k, v in {**RESULT_CONF, **SKEW_CONF}.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and
    is only read here; where it is unset that is an error. Only in local mode
    (tests) do we pick a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="stockroom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (for written tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stockroom/{name}-{uuid.uuid4().hex}"
