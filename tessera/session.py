"""Session defaults, table access and cluster-safe materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch handed to a Python worker, so a worker's memory does not follow document length.
ARROW_BATCH_BYTES = 8 << 20
#: Spark 4.1 takes a union of equally partitioned sides as partitioned, but at run time joins the sides' partitions differently, and
#: groups are then split: a fused ranking of 200 rows came out with 318.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and bounds Arrow batches; keeps whatever the session has set, but for UNION_PARTITIONING."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set(UNION_PARTITIONING, "false")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > ARROW_BATCH_BYTES:
            spark.conf.set(key, str(ARROW_BATCH_BYTES))
    except Exception:  # a session without this setting keeps its row bound
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or what the context has been given as checkpoint folder.

    Only where neither is set and the master is local, a folder of this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder is None and held.isDefined():
        folder = held.get()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the input has fewer splits than that (one small file); as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few_files(df: DataFrame) -> DataFrame:
    """The rows in as few partitions as their size needs: a result of small rows need not be written in as many files as its shuffle had.

    The planner splits and joins partitions by their size at run time; the stage before keeps all of its tasks.
    """
    return df.hint("rebalance")


def materialised(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes a table into the shared folder and reads it again. The files go when the application ends.

    Unlike a checkpoint this gives the planner the table's true size, where in a loop the estimates of joins would multiply,
    and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables, which nothing may read any more: in a loop, those of the round before."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
