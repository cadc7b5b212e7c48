"""A Parquet cache beside file imports: a miss or a failure never fails the import.

Tables lie where driver and executors both see them: a folder named by STATLOOM_CACHE_DIR or
spark.statloom.cacheDir, the user's cache folder in a local session, else the shared folder of the
cluster.  Each writer writes a folder of its own and then renames a marker into place that names
it; readers follow the marker, so a table is seen whole or not at all, whoever else is writing.  The
marker's name holds the file's size and time, so a file that has changed is a miss.
Cells that don't fit their column's type are in the table too, as text (see infer.RAW).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder
from .base import ImportOptions

FORMAT = 2


def cache_dir(spark: SparkSession) -> str:
    """The environment's or session's choice, else the user's cache folder in a local session, else the shared folder."""
    if own := os.environ.get("STATLOOM_CACHE_DIR") or spark.conf.get("spark.statloom.cacheDir", None):
        return own.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        for var, parts in (("LOCALAPPDATA", ("statloom", "cache")), ("XDG_CACHE_HOME", ("statloom",)), ("HOME", (".cache", "statloom"))):
            if base := os.environ.get(var):
                return str(Path(base, *parts))
    return f"{shared_folder(spark)}/statloom-cache"


class _Files:
    """Hadoop's file system of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def stamp(self, path: str) -> str:
        s = self.fs.getFileStatus(self.path(path))
        return f"{FORMAT}-{s.getLen()}-{s.getModificationTime()}"

    def names(self, folder: str) -> list[str]:
        found = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(found)] if self.fs.exists(found) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _entry(spark: SparkSession, path: str, object: str | None, options: ImportOptions) -> str:
    full = os.path.realpath(path)
    key = hashlib.sha256(json.dumps([full, object, options.as_dict()], sort_keys=True).encode()).hexdigest()[:32]
    return f"{cache_dir(spark)}/{key}"


def read(spark: SparkSession, path: str, object: str | None, options: ImportOptions) -> DataFrame | None:
    """The cached table, or None if there is none that fits the file as it is now."""
    if "://" in path:
        return None
    try:
        entry = _entry(spark, path, object, options)
        marker = f"{entry}/{_Files(spark, path).stamp(path)}.json"
        meta = json.loads(_Files(spark, entry).read(marker))
        df = spark.read.parquet(f"{entry}/{meta['folder']}")
        return df if df.columns == meta["columns"] else None
    except Exception:  # whatever is wrong with the cache, the import goes on
        return None


def write(df: DataFrame, path: str, object: str | None, options: ImportOptions) -> bool:
    """Whether a table that fits the file is in the cache now; it may be another writer's."""
    if "://" in path:
        return False
    spark = df.sparkSession
    files = mine = None
    try:
        entry = _entry(spark, path, object, options)
        source, files = _Files(spark, path), _Files(spark, entry)
        stamp, folder = source.stamp(path), f"table-{uuid.uuid4().hex}"
        mine = f"{entry}/{folder}"
        df.write.parquet(mine, compression="snappy")
        if source.stamp(path) != stamp:  # the file changed while it was read
            files.delete(mine)
            return False
        draft = f"{mine}/_marker"
        files.write(draft, json.dumps({"folder": folder, "columns": df.columns}))
        older = [n for n in files.names(entry) if n.endswith(".json") and n != f"{stamp}.json"]
        marker = f"{entry}/{stamp}.json"
        if not files.rename(draft, marker):
            if read(spark, path, object, options) is not None:
                files.delete(mine)  # another writer was first, with the same rows
                return True
            files.delete(marker)  # what is there can't be read
            if not files.rename(draft, marker):
                files.delete(mine)
                return read(spark, path, object, options) is not None
        for name in older:  # tables of the file as it was
            files.delete(f"{entry}/{json.loads(files.read(f'{entry}/{name}'))['folder']}")
            files.delete(f"{entry}/{name}")
        return True
    except Exception:  # as above
        if files is not None and mine is not None:
            try:
                files.delete(mine)
            except Exception:
                pass
        return False
