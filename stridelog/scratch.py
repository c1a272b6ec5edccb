"""Tables that cut lineage.

``scratch_dir`` names the folder that every executor can reach; ``materialize``
cuts lineage there with a Parquet table, so a lost executor costs a re-read and
never a re-run of everything upstream. Nothing here uses local checkpoints, and a
machine-local folder only in local mode without a shared one (tests).

A frame may be read again until its last action, so its tables stay until
``release`` (one that a later table replaces) or ``clear`` (all of a session, when
results are written).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tests write when the session names no shared folder.
_fallback: list[str] = []
#: Tables written and not deleted yet.
_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temp folder in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="stridelog-"))
    return _fallback[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stridelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def new_folder(spark: SparkSession) -> str:
    """A name below the shared folder for what is not a table; ``clear`` deletes it too."""
    path = f"{scratch_dir(spark)}/stridelog-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    _delete(df.sparkSession, df.written_to)


def clear(spark: SparkSession) -> None:
    """Delete all tables of ``materialize``: for when results are written elsewhere."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)
