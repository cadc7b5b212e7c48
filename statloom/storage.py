"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Only a local session gets a temporary one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="statloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(df read back from the shared folder, number of rows): what is above it runs once, and lost executors don't undo it."""
    seen = Observation()
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def handed_out(spark: SparkSession, path: str) -> str:
    """The name under which tasks find a file of the driver (SparkFiles); each call has its own, as a file may have changed."""
    folder = tempfile.mkdtemp(prefix="statloom-file-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    served = Path(folder, uuid.uuid4().hex + Path(path).suffix)
    try:
        os.link(os.path.realpath(path), served)  # Spark would follow a symbolic link
    except OSError:
        shutil.copyfile(path, served)
    spark.sparkContext.addFile(str(served))
    return served.name
