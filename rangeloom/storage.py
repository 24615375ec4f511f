"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none a local folder is set on one machine, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"rangeloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and files outlive executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    note(df.sparkSession, path)
    return back


#: The scratch blocks around the running code, innermost last; each thread has its own.
_open: ContextVar[tuple] = ContextVar("scratch", default=())


def note(spark: SparkSession, path: str) -> None:
    """The scratch blocks around delete ``path`` at their end."""
    for s in _open.get():
        s.stored[path] = spark


class scratch:
    """Deletes, at its end, the tables that were stored inside it, but for those it is told to keep."""

    def __enter__(self):
        self.stored: dict[str, SparkSession] = {}
        self._token = _open.set((*_open.get(), self))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.stored.pop(getattr(df, "_stored_at", None), None)
        return df

    def __exit__(self, *failed):
        _open.reset(self._token)
        if failed[0] is None:
            for path, spark in self.stored.items():
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
