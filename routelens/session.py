"""Session construction and lineage management.

Cluster settings win: anything already configured on the session (for example
``spark.checkpoint.dir`` pointing at shared storage) is read, never replaced.
A private checkpoint folder is only created when nothing is configured, which
happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings chosen for the 100 TB target; every one of them is a plain Spark knob.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rebalance oversized partitions produced by explode / hot repositories
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # joins of exploded tokens against small key sets (known schemas, terms, candidate
    # postings) get a runtime Bloom filter that prunes the token side before the shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

ROWS_A_TASK = 500_000  # of rows dealt by ``spread``

# Only honoured when this process starts the JVM (local runs and tests).
LOCAL_DEFAULTS = {"spark.driver.memory": "12g"}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "routelens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**LOCAL_DEFAULTS, **SCALE_DEFAULTS}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (the cluster's shared folder). Only when it is
    unset - local tests - a private folder is created and registered.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="routelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used by iterative jobs (frontier rounds) so the plan stays flat and a lost
    executor re-reads the materialised round instead of recomputing all rounds.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    Ends the lineage like a checkpoint, but the rows are computed once, and readers take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(*stages: DataFrame) -> None:
    """Remove tables of ``write_stage`` that nothing later is computed from, and let the driver collect what it no longer
    refers to: Spark deletes the shuffle files of the jobs that wrote them only then."""
    for df in stages:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    if stages:
        stages[0].sparkSession.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions by ``keys``, over more where ``rows`` of them would not fit.

    For rows that grow in the work ahead: small files hold many of them, and a scan alone, or partitions joined by their
    bytes, would leave all of it to a few tasks.  A task sorts or hashes about ``ROWS_A_TASK`` rows, however many there are.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
                              -(-rows // ROWS_A_TASK)), *keys)
