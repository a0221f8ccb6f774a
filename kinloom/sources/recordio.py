"""RecordIO files (``.rec`` with a text ``.idx``) as a data source and a sink.

A record is framed by a magic number and its length and padded to four bytes; its
content starts with a header (flag, label, id, id2), followed by ``flag`` further
float labels when flag > 0, then the payload. Record 0 may be a file header,
recognised by flag > 0; it and the per-class headers it bounds hold no payload
row and are left out. A truncated record ends its file. A file with an index is
split over its records; one without is read from end to end by one task, its
records numbered from 0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC = 0xCED7230A
FRAME = struct.Struct("<II")
HEADER = struct.Struct("<IfQQ")
SCHEMA = "rec_path string, rec_idx long, label double, payload binary"
RANGE_RECORDS = 50_000


def _open(path: str):
    fs, place = pafs.FileSystem.from_uri(path)
    return fs, place


def read_index(path: str) -> list[tuple[int, int]]:
    """(record number, byte offset) of an index file, in byte order."""
    fs, place = _open(path)
    with fs.open_input_stream(place) as f:
        rows = [line.split("\t") for line in f.read().decode().splitlines() if line]
    return sorted(((int(k), int(v)) for k, v in rows), key=lambda x: x[1])


def pack(label: float, rec_id: int, payload: bytes, labels: tuple[float, ...] = ()) -> bytes:
    body = HEADER.pack(len(labels), 0.0 if labels else label, rec_id, 0) + b"".join(struct.pack("<f", x) for x in labels) + payload
    return FRAME.pack(MAGIC, len(body)) + body + b"\0" * (-len(body) % 4)


def unpack(body: bytes) -> tuple[int, list[float], bytes]:
    flag, label, _, _ = HEADER.unpack_from(body)
    at = HEADER.size + 4 * flag
    labels = list(struct.unpack_from(f"<{flag}f", body, HEADER.size)) if flag else [label]
    return flag, labels, body[at:]


class _Range(InputPartition):
    """Records of one file as (number, offset); no rows: the whole file in its order."""

    def __init__(self, path: str, rows: list[tuple[int, int]] | None, images: int):
        self.path, self.rows, self.images = path, rows, images


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Range]:
        out = []
        for p in self.paths:
            fs, index = _open(p[: -len(".rec")] + ".idx")
            indexed = fs.get_file_info(index).type != pafs.FileType.NotFound
            rows = read_index(p[: -len(".rec")] + ".idx") if indexed else [(0, 0)]
            images = -1
            fs, place = _open(p)
            if rows and fs.get_file_info(place).size > FRAME.size:
                with fs.open_input_file(place) as f:
                    magic, n = FRAME.unpack(f.read_at(FRAME.size, rows[0][1]))
                    flag, labels, _ = unpack(f.read_at(n & 0x1FFFFFFF, rows[0][1] + FRAME.size)) if magic == MAGIC else (0, [], b"")
                if flag > 0:
                    images = int(labels[0])
            if not indexed:
                out.append(_Range(p, None, images))
                continue
            out += [_Range(p, rows[i : i + RANGE_RECORDS], images) for i in range(0, len(rows), RANGE_RECORDS)]
        return out or [_Range("", [], -1)]

    @staticmethod
    def _all(f) -> Iterator[tuple[int, int]]:
        number, at, size = 0, 0, f.size()
        while at + FRAME.size <= size:
            magic, n = FRAME.unpack(f.read_at(FRAME.size, at))
            if magic != MAGIC:
                return
            yield number, at
            n &= 0x1FFFFFFF
            number, at = number + 1, at + FRAME.size + n + -n % 4

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        fs, place = _open(part.path)
        with fs.open_input_file(place) as f:
            for number, offset in part.rows if part.rows is not None else self._all(f):
                if part.images >= 0 and (number == 0 or number >= part.images):
                    continue
                head = f.read_at(FRAME.size, offset)
                if len(head) < FRAME.size:
                    return
                magic, n = FRAME.unpack(head)
                n &= 0x1FFFFFFF
                body = f.read_at(n, offset + FRAME.size)
                if magic != MAGIC or len(body) < n:
                    return
                _, labels, payload = unpack(body)
                yield part.path, number, float(labels[0]), payload


class RecordIO(DataSource):
    """``spark.read.format("kinloom_recordio").option("paths", "a.rec,b.rec").load()``; register with :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return "kinloom_recordio"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split(",") if p])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordIO)


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("kinloom_recordio").option("paths", ",".join(paths)).load()


def write_records(df: DataFrame, folder: str) -> DataFrame:
    """Write ``label, payload`` rows, one ``.rec``/``.idx`` pair per partition, records numbered from 1; returns ``rec_path, n_records``.

    Files are written under a temporary name and renamed when whole, so a lost
    task leaves no half file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, place = _open(folder)
        fs.create_dir(place, recursive=True)
        stem = f"{place}/part-{TaskContext.get().partitionId():05d}"
        tmp = f"{stem}.{TaskContext.get().taskAttemptId()}"
        index, at, n = [], 0, 0
        with fs.open_output_stream(f"{tmp}.rec") as f:
            for pdf in batches:
                for label, payload in zip(pdf["label"], pdf["payload"], strict=True):
                    n += 1
                    record = pack(float(label), n, bytes(payload))
                    f.write(record)
                    index.append(f"{n}\t{at}\n")
                    at += len(record)
        with fs.open_output_stream(f"{tmp}.idx") as f:
            f.write("".join(index).encode())
        for suffix in ("idx", "rec"):
            fs.move(f"{tmp}.{suffix}", f"{stem}.{suffix}")
        yield pd.DataFrame({"rec_path": [f"{stem}.rec"], "n_records": [n]})

    from kinloom.plans.lineage import cut

    return cut(df.select("label", "payload").mapInPandas(write, "rec_path string, n_records long"))
