"""Session defaults and the shared folder in which intermediate tables are cut from their lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weirflow")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_one_machine(master: str) -> None:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone gets a temporary folder
    that goes with the process; any other session is an error, as executors
    would each write to a disk of their own.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("weirflow.shared.dir", None)
    if not found:
        require_one_machine(spark.sparkContext.master)
        own = tempfile.mkdtemp(prefix="weirflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("weirflow.shared.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder, for tables that nothing reads after it."""
    found = spark.conf.get("weirflow.run.dir", None)
    if not found:
        found = os.path.join(shared_dir(spark), f"weirflow-{uuid.uuid4().hex}")
        spark.conf.set("weirflow.run.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written files cut the lineage, survive the loss of executors and keep
    branches that read the same intermediate result from computing it twice.
    They stay until ``release``, as results are lazy and read them later.
    """
    path = os.path.join(run_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session; results that read them must have been used by then."""
    found = spark.conf.get("weirflow.run.dir", None)
    if found:
        target = spark._jvm.org.apache.hadoop.fs.Path(found)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        spark.conf.unset("weirflow.run.dir")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
