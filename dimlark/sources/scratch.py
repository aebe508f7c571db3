"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession

#: Used only by a local session that names no folder of its own.
LOCAL_SHARED = "/tmp/checkpoints"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out; its folder goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    uri = f"{(root or f'file://{LOCAL_SHARED}').rstrip('/')}/dimlark-{tag}-{uuid.uuid4().hex}"
    if not root:
        atexit.register(shutil.rmtree, uri.removeprefix("file://"), ignore_errors=True)
    return uri
