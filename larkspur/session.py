"""Reading tables, and the few things that depend on the running session."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables, which the session names
    in ``spark.checkpoint.dir``; a session that names none must set it (or
    ``SparkContext.setCheckpointDir``) first. Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have checkpoints removed."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"  # a local run, as in tests
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so that a lost
    executor costs a re-read and not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` (already cheap to read, for instance after :func:`cut`) marked for
    broadcast if it has at most ``max_rows`` rows; else unmarked, so that Spark
    joins it by shuffle. The size is counted, not assumed."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
