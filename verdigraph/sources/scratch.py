"""Written tables that end a plan's lineage, in the folder that a cluster shares, and checks of size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where that is unset and Spark is local, one of our own (tests)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("spark.verdigraph.scratch", None)
    if not at:
        if not conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="verdigraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.verdigraph.scratch", at)
    return at.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing of it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; looks at no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is known to have at most so many rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, rows) else df
