"""Session settings that the operators expect, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC and give it a checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a fresh temporary folder is taken. A cluster without a
    shared folder is an error, as its executors couldn't read what another one wrote.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark


def local_session(cores: int = 8, app: str = "skytally") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKYTALLY_DRIVER_MEMORY", "8g"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on."""
    prepare(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read that from now on.

    For loops: a checkpoint keeps the size that was estimated for its plan, and over rounds
    of joins those estimates multiply until planning takes longer than the work. A table
    has the size of its files.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def standing(df: DataFrame) -> bool:
    """Whether ``df`` is read straight from a checkpoint, so that another one would only copy it."""
    return df._jdf.queryExecution().logical().getClass().getSimpleName() == "LogicalRDD"
