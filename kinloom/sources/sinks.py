"""Sinks: row-capped and partitioned Parquet, text forms, archives per entity, and publishing a finished folder."""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut


def write_chunks(df: DataFrame, path: str, rows: int) -> None:
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Hive layout; rows of one value come together first, split further by AQE where one value is large."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """``csv`` with header, ``json`` lines, or ``text`` of one string column."""
    (df.write.option("header", True) if fmt == "csv" else df.write).format(fmt).save(path)


def write_manifest(df: DataFrame, path: str, split: str = "src") -> None:
    """``final_id, img_key`` per split, in order of both within a file; rows without a label of 0 or more are left out."""
    rows = df.where("final_id >= 0").select(split, "final_id", "img_key")
    rows.repartitionByRange(split, "final_id", "img_key").sortWithinPartitions(split, "final_id", "img_key").write.partitionBy(split).parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Replace a folder by a finished one: write beside it, then swap names. The folder that is read is never written into."""
    fs, place = pafs.FileSystem.from_uri(path)
    fresh = f"{place}.{uuid.uuid4().hex}"
    df.write.parquet(path.replace(place, fresh))
    old = f"{fresh}.old"
    if fs.get_file_info(place).type != pafs.FileType.NotFound:
        fs.move(place, old)
    fs.move(fresh, place)
    if fs.get_file_info(old).type != pafs.FileType.NotFound:
        fs.delete_dir(old)


def write_archives(df: DataFrame, folder: str, entity: str, name: str, payload: str, rows: int = 5_000) -> DataFrame:
    """One tar per entity and part of at most ``rows`` members; returns ``tar_path, n_members``.

    A large entity becomes several archives, so no task holds more than ``rows`` members.
    """
    parts = df.groupBy(entity).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    slim = df.join(parts, entity).select(F.col(entity).cast("string").alias("entity"), F.col(name).alias("name"), F.col(payload).alias("payload"), F.pmod(F.xxhash64(name), F.col("_parts")).cast("int").alias("part"))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, place = pafs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        out = f"{place}/{key[0]}-{key[1]:04d}.tar"
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w") as tar:
            for n, body in sorted(zip(pdf["name"], pdf["payload"], strict=True)):
                info = tarfile.TarInfo(n)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(bytes(body)))
        tmp = f"{out}.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as f:
            f.write(buffer.getvalue())
        fs.move(tmp, out)
        return pd.DataFrame({"tar_path": [out], "n_members": [len(pdf)]})

    return cut(slim.groupBy("entity", "part").applyInPandas(write, "tar_path string, n_members long"))
