"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


#: Folders of local applications whose session names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a local session that names none (tests) gets a temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and reread: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


#: Rows of a task of in_tasks().
TASK_ROWS = 100_000


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in as many tasks as give each about TASK_ROWS of its rows, however many there are.

    Spark's own number of shuffle tasks has a fixed upper bound, and adaptive execution fills them by the bytes shuffled, so
    sorts of rows that grow wide after the shuffle take memory in proportion.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def forget(df: DataFrame | None) -> None:
    """Delete the files of a table made by saved() that no result depends on any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Give back what the driver holds and does not use, between the steps of a long job.

    Spark cleans broadcasts and shuffle files up only when the driver collects its garbage; freed native memory, most of it
    from compiling queries, goes back to the system where the JVM has a command for that.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(bean, "systemTrimNativeHeap", None, None)
    except Py4JError:  # other systems and older JVMs have no such command
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
