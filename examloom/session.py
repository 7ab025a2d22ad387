"""Session defaults for running outside the driver harness."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cores: int | str = 8, app: str = "examloom", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("EXAMLOOM_DRIVER_MEMORY", "12g"))
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session may lack one: it gets a temporary folder for all its work. On a cluster a folder of one
    machine would lose rows, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local_base(spark: SparkSession) -> str:
    """One temporary folder per local session; the setting can't be changed on a running session."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _bases:
        _bases[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _bases[app]


_bases: dict[str, str] = {}


#: Input files (compressed) that one task of a sized shuffle stands for; sorted rows take some twenty times as much memory.
TASK_BYTES = 8 << 20


def sized(df, *keys: str):
    """Shuffle by keys into as many parts as the input asks for, where the session's number of parts would be too few.

    That number is fixed, so without this the rows and the memory of a task grow with the input. A small input is left
    as it is, and a join or grouping by the keys that follows needs no other shuffle.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    parts = sum(n for n in sizes if n < 2**62) // TASK_BYTES + 1  # tables of unknown size count as endless
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class _Scopes(threading.local):
    """Folders made inside each open `scratch` of a thread, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def materialize(df, name: str):
    """Write an intermediate result that several branches read, and read it back.

    Cuts the lineage through the shared folder, so a lost executor costs one task, not a recomputation
    of every branch, and gives the planner real sizes. Inside `scratch` the folder goes with the others.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Remove at the end all folders that `materialize` makes inside.

    Yields a function like `materialize` for the result: its folder stays (for an outer `scratch`, if any).
    """
    made: list[str] = []
    outer = _scopes.open[-1] if _scopes.open else None
    _scopes.open.append(made)

    def keep(df, name: str):
        out = materialize(df, name)
        path = made.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _scopes.open.pop()  # scopes nest, so this is `made`
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
