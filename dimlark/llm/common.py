"""Shared helpers: the shared scratch folder, written intermediate tables, digests."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local session that names no folder of its own.
LOCAL_SHARED = "/tmp/checkpoints"

#: ASCII white space; words of several operators are runs of anything else.
NON_SPACE_RUN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave the setting out; then a folder under ``/tmp/checkpoints``
    is taken, which goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_SHARED}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI in the shared folder; nothing is created yet."""
    uri = f"{shared_dir(spark)}/dimlark-{tag}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.checkpoint.dir", None):
        atexit.register(shutil.rmtree, uri.removeprefix("file://"), ignore_errors=True)
    return uri


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and lineage ends here."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash01(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))
