"""Session helpers: a builder for local runs and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass the session you already have."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that see the driver's folders import this package from where the driver did."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


#: Work folders made by this process, for ``clean``.
_made: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job's written tables and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``, or else in the one given to
    ``SparkContext.setCheckpointDir``. Only a local master may go without, because a machine-local
    folder is useless to other executors.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    ) or spark.sparkContext.getCheckpointDir()
    if shared:
        _made.append(f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
        return _made[-1]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    _made.append(tempfile.mkdtemp(prefix=f"tidemark-{purpose}-"))
    return _made[-1]


def clean(spark: SparkSession) -> list[str]:
    """Delete the work folders made so far by this process; returns them.

    Results of queries are read from these folders until they are stored, so store them first. Folders given
    by a caller, such as a mirror's, are not touched.
    """
    gone = []
    while _made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made[-1])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        gone.append(_made.pop())
    return gone


def written(df, purpose: str):
    """``df`` as a table in the shared folder, for results that several branches of a job read."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(spark: SparkSession, path: str) -> bool:
    """Whether the writer of ``path`` has finished and left its success mark."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def checkpoint(df):
    """Cut the lineage of ``df`` through a table in the shared folder.

    ``DataFrame.checkpoint`` keeps the constraints and size estimates of the plan it cuts. In loops the first
    grow with every round until planning takes all the driver's time and memory, and the second are far too low
    behind an ``explode``, so that whole tables are broadcast.
    """
    return written(df, "checkpoint")
