"""Cutting lineage through the folder that the cluster shares.

Iterative operators write their state between rounds as tables there. The folder
is the one named by ``spark.checkpoint.dir``; only a local session without that
setting gets a temporary folder of its own. All tables of an application lie in one
folder below, which is removed when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def _remove(folder: str) -> None:
    try:
        fs, place = pafs.FileSystem.from_uri(folder)
        if fs.get_file_info(place).type != pafs.FileType.NotFound:
            fs.delete_dir(place)
    except OSError:
        # the folder's own life time then ends it
        return


def ensure_shared_folder(spark: SparkSession) -> str:
    """The application's folder in the shared folder of the session; raises on a cluster that names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinloom-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    own = f"{found.rstrip('/')}/kinloom-{sc.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a checkpoint, the table has a known size, so small states of late
    rounds are joined by broadcast, and it carries no constraints of its past,
    which would make the plans of many rounds grow.
    """
    spark = df.sparkSession
    path = f"{ensure_shared_folder(spark)}/kinloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
