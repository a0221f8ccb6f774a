"""File sources beside Parquet. Every reader is distributed and takes the path as a parameter.

Defined results: unreadable lines and members are left out of the rows and can be
listed by the reject variants; missing scores default to 1.0.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def spaced_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lists without header, fields separated by one space (image template medium; template template label)."""
    return spark.read.csv(path, sep=" ", header=False, schema=schema)


def landmark_lines(spark: SparkSession, path: str, points: int = 5) -> DataFrame:
    """``name x1 y1 ... [score]`` per line."""
    parts = F.split(F.trim("value"), r"\s+")
    p = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    xy = F.transform(F.slice("p", 2, 2 * points), lambda x: x.try_cast("double"))
    return p.where(F.size("p") > 2 * points).select(F.col("p")[0].alias("name"), xy.alias("landmark"), F.coalesce(F.try_element_at("p", F.lit(2 * points + 2)).try_cast("double"), F.lit(1.0)).alias("score"))


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ids of text files, one or several per line."""
    ids = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"[\s,]+")).alias("x"))
    return ids.select(F.col("x").try_cast("long").alias("id")).where("id is not null").distinct()


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, length, modified`` of all files below; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def labelled_files(spark: SparkSession, path: str, pattern: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """``path, label, payload`` of an image folder; the label is the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", pattern, 1).alias("label"), F.col("content").alias("payload"))


def tar_members(spark: SparkSession, path: str, suffix: str = "", payload: bool = False) -> DataFrame:
    """``tar_path, member_name, start_byte, length`` (and ``payload``) of the members of all archives below; one archive per row of work."""
    schema = "tar_path string, member_name string, start_byte long, length long" + (", payload binary" if payload else "")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith(suffix):
                                body = bytes(content[m.offset_data : m.offset_data + m.size])
                                rows.append((name, m.name, m.offset_data, m.size, body)[: 5 if payload else 4])
                except tarfile.TarError:
                    # see unreadable_archives
                    rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar").load(path)
    # a few archives per batch, as each is held whole
    return files.select("path", "content").mapInPandas(members, schema)


def unreadable_archives(spark: SparkSession, path: str) -> DataFrame:
    """``tar_path, error`` of the archives below that cannot be opened."""

    def failed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        tar.getmembers()
                except tarfile.TarError as e:
                    rows.append((name, str(e)))
            yield pd.DataFrame(rows, columns=["tar_path", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar").load(path)
    return files.select("path", "content").mapInPandas(failed, "tar_path string, error string")


def byte_ranges(df: DataFrame, path: str, start: str, length: str, out: str = "payload") -> DataFrame:
    """Adds the bytes of ``[start, start + length)`` of each row's file; rows are sorted by file so a file is opened once per batch."""

    @F.pandas_udf("binary")
    def read(paths: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        result: list[bytes | None] = [None] * len(paths)
        frame = pd.DataFrame({"p": paths.to_numpy(), "s": starts.to_numpy(), "n": lengths.to_numpy()})
        for p, rows in frame.groupby("p"):
            fs, place = pafs.FileSystem.from_uri(p.replace("file:///", "/") if p.startswith("file:") else p)
            with fs.open_input_file(place) as f:
                for i, s, n in zip(rows.index, rows["s"], rows["n"], strict=True):
                    result[i] = f.read_at(int(n), int(s))
        return pd.Series(result)

    return df.repartition(F.col(path)).sortWithinPartitions(path, start).withColumn(out, read(path, start, length))
