"""Spark session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import logging
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def local_session(cores: int = 8, app: str = "tallyloom") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs a stack walk per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory used to cut lineage: the cluster's shared folder when it names one.

    A temporary folder is chosen only in local mode with nothing configured; on a
    cluster a missing setting is an error, because machine-local checkpoints do
    not survive the loss of an executor.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


_run_folders: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, removed when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _run_folders:
        _run_folders[app] = f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _run_folders[app])
    return _run_folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception as gone:  # the session has ended; the shared folder's own clean-up is left
        log.info("intermediate tables stay in %s: %s", path, gone)


def materialise(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a columnar table under the checkpoint folder and read it back.

    For tables that several passes scan: the passes then see short plans, file
    statistics and column pruning, and a lost executor re-reads files.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generated_apart(df: DataFrame) -> DataFrame:
    """The same rows and partitions, with the code of what follows generated apart from what came before.

    A long chain of projections becomes one method, which the virtual machine does not compile beyond a certain
    size. A coalesce to more partitions than there are moves nothing and ends the method.
    """
    return df.coalesce(2**31 - 1)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
    return repr(v)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few literal rows as a local relation.

    Its exact size is known to the optimiser, which decides on a broadcast by itself,
    and no Python worker is involved in reading it.
    """
    fields = StructType.fromDDL(schema).fields
    cols = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in fields)
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(f.name for f in fields)})")
