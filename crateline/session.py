"""Session construction and the few settings the operators depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "crateline", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    Nothing machine specific is set here: executor memory, parallelism and the
    checkpoint folder belong to the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where none is set and the master is a single machine (tests) a temporary
    folder is made; on a real cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="crateline-checkpoint-"))


def cut_lineage(df: DataFrame, keep_estimate: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A checkpoint keeps the planner's estimate of the size, and a join is
    estimated by the product of its sides. A loop that joins its own result must
    not keep it: its digits double with each round, until multiplying them takes
    all time and memory of the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if keep_estimate:
        return kept
    rows, schema = kept._jdf.queryExecution().toRdd(), kept._jdf.schema()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, schema, False), df.sparkSession)
