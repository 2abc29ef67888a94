"""Session helpers: local sessions for tests, and reliable cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "chunkspark", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster, pass your own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which a cluster shares. Where it is unset a local master, whose executors
    are this very process, gets a temporary one; any other master is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chunkspark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: survives the loss of executors. Spark removes the
    files when nothing refers to them any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set. With ``free``
    the shuffle files behind ``df`` go as soon as it is written, not when the driver happens to collect its garbage."""
    shared_folder(df.sparkSession)
    if not free:
        return df.checkpoint(eager=True)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the plans made and run here go when they have run."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """The same as a compressed table, for wide rows of which several steps read some columns each. The table stays in
    the shared folder of this application."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freeing(df.sparkSession) if free else nullcontext():
        (df.select("*") if free else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores, if it has fewer: a small file with a single row group
    would keep all but one of them waiting. A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
