"""Consolidating very many small files into few well-sized ones (problem 3).

Method: sorted-run consolidation. A task's share of the small files is parsed,
sorted once by the *composite* key (object path, file, line) and written as one
sorted run in the shared folder. Key ranges are cut at quantiles of a bounded
sample of composite keys, one range per ``TARGET_BYTES``, so an object standing in
a third of all files lies in several ranges instead of filling one task. A task
per range opens the runs that reach into it, merges them (a heap over the runs'
streams, so it holds one batch a run) and

* keeps every duplicate and numbers the copies of one object, over all ranges,
* writes the first copies as JSON lines, rolling to a new file before its encoded
  bytes would pass the target,
* reports every record with the name of the file that holds its object.

Range metadata name the files that were written. A file has a name of its own per
attempt, so a task that is run again leaves no wrong file in the metadata.

Defined results: null and empty bodies hold no record; a line that is cut off
(unclosed JSON object, unclosed quote, missing field, number without digits)
holds none; ``n_bytes`` is never trusted; a repeated line is a duplicate record.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import canonical_path
from kinloom.plans.lineage import cut, ensure_shared_folder

TARGET_BYTES = 128 << 20
SAMPLE = 32
_JSON = "person_id string, aligned_s3_path string, det double"
_FIELD = r'("(?:[^"]++|"")*+"|[^,"]*+)(?:,|$)'
_COLUMNS = ("person_id", "aligned_s3_path", "det")
_KEY = ["obj", "file_key", "line_no"]
_MERGED = "range_no int, obj string, file_key string, line_no int, person_id long, det double, n_bytes long, copy_no long, out_file string"


def parse_records(files: DataFrame) -> DataFrame:
    """``file_key, body`` -> one row per whole record: ``obj, file_key, line_no, person_id, det, n_bytes``.

    Understands JSON objects by line (ids as numbers or texts) and CSV with a
    header line in any column order (without one: person_id, path, det).
    """
    body = files.select("file_key", F.regexp_replace("body", "^﻿", "").alias("body"))
    first = F.regexp_extract("body", r"^\s*([^\r\n]*)", 1)
    lines = body.withColumn("head", F.when(first.contains("aligned_s3_path") & ~first.startswith("{"), first)).select(
        "file_key", "head", F.split("body", r"\r\n|\n|\r").alias("lines")
    )
    lines = lines.select("file_key", "head", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> '' and (head is null or line <> head)")
    names = F.transform(F.split(F.coalesce("head", F.lit(",".join(_COLUMNS))), ","), lambda x: F.regexp_replace(x, r'[\s"]', ""))
    is_json = F.col("line").startswith("{")
    cells = F.when(~is_json, F.regexp_extract_all("line", F.lit(_FIELD), 1))
    # the pattern also matches the empty rest after a full line
    lines = lines.withColumns(
        {
            "is_json": is_json,
            "j": F.when(is_json & F.col("line").endswith("}"), F.from_json("line", _JSON)),
            "names": names,
            "cells": cells,
        }
    )

    def cell(name: str):
        raw = F.try_element_at("cells", F.array_position("names", name).cast("int"))
        return F.replace(F.regexp_replace(raw, r'^"|"$', ""), F.lit('""'), F.lit('"'))

    whole = (F.size("names") <= F.size("cells")) & (~F.col("line").contains('"') | F.col("line").rlike(r'^(?:(?:"(?:[^"]++|"")*+"|[^,"]*+)(?:,|$))++$')) & cell("det").rlike(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$")
    # without a line end after it, a bare 0 or 1 is the start of a fraction
    whole = whole & ((F.col("line_no") < F.col("n_lines") - 1) | cell("det").contains("."))
    parsed = lines.select(
        "file_key",
        "line_no",
        F.length("line").alias("n_bytes"),
        F.when(F.col("is_json"), F.col("j.aligned_s3_path")).when(whole, cell("aligned_s3_path")).alias("path"),
        F.when(F.col("is_json"), F.col("j.person_id")).otherwise(cell("person_id")).try_cast("long").alias("person_id"),
        F.when(F.col("is_json"), F.col("j.det")).otherwise(cell("det").try_cast("double")).alias("det"),
    )
    return parsed.select(canonical_path(F.col("path")).alias("obj"), "file_key", "line_no", "person_id", "det", "n_bytes").where("obj <> ''")


def sorted_runs(records: DataFrame) -> str:
    """Write one sorted run per task to the shared folder; the path of the runs."""
    path = f"{ensure_shared_folder(records.sparkSession)}/kinloom-runs-{uuid.uuid4().hex}"
    records.select(*_KEY, "person_id", "det").sortWithinPartitions(*_KEY).write.parquet(path)
    return path


def _order(row: tuple) -> tuple:
    """Spark's order of the composite key: a missing file name comes first."""
    return row[0], row[1] is not None, row[1] or "", row[2]


def _line(obj: str, person_id: int | None, det: float | None) -> bytes:
    return (json.dumps({"aligned_s3_path": obj, "person_id": person_id, "det": det}, ensure_ascii=False) + "\n").encode()


def range_bounds(runs: DataFrame, target_bytes: int) -> list[tuple]:
    """Composite keys between the ranges: quantiles of about ``SAMPLE`` keys a range, drawn by a hash. Bounded by the number of output files."""
    # a line is at most its fields and names
    n, size = runs.agg(F.count("*"), F.sum(F.octet_length("obj") + 80)).first()
    ranges = -(-(size or 0) // target_bytes)
    if ranges < 2:
        return []
    share = F.pmod(F.xxhash64(*_KEY), F.lit(1 << 20)) < max(1, (1 << 20) * SAMPLE * ranges // n)
    keys = sorted((tuple(r) for r in runs.where(share).select(*_KEY).collect()), key=_order)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}, key=_order) if keys else []


def merge_runs(records: DataFrame, target_bytes: int = TARGET_BYTES, folder: str | None = None) -> DataFrame:
    """All records, duplicates preserved, merged per key range and written to files in ``folder``: see ``_MERGED``; ``copy_no`` 1 is the first of its object."""
    spark = records.sparkSession
    path = sorted_runs(records)
    runs = spark.read.parquet(path)
    bounds = range_bounds(runs, target_bytes)
    folder = (folder or f"{ensure_shared_folder(spark)}/kinloom-files-{uuid.uuid4().hex}").rstrip("/")

    def stream(file: pads.Fragment, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
        inside = None
        if low is not None:
            inside = pads.field("obj") >= low[0]
        if high is not None:
            below = pads.field("obj") <= high[0]
            inside = below if inside is None else inside & below
        for batch in file.to_batches(columns=[*_KEY, "person_id", "det"], filter=inside):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low is None or _order(row) >= _order(low)) and (high is None or _order(row) < _order(high)):
                    yield row

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for no in (int(x) for pdf in batches for x in pdf["id"]):
            fs, place = pafs.FileSystem.from_uri(path)
            to_fs, to = pafs.FileSystem.from_uri(folder)
            to_fs.create_dir(to)
            low, high = (bounds[no - 1] if no else None), (bounds[no] if no < len(bounds) else None)
            files = list(pads.dataset(place, filesystem=fs, format="parquet").get_fragments())
            rows, out, size, name, last, copies = [], None, 0, "", None, 0
            # a range that begins inside an object leaves its line to the range before
            begun = low is not None and any(True for f in files for _ in stream(f, (low[0], None, -1), low))
            for row in heapq.merge(*(stream(f, low, high) for f in files), key=_order):
                obj, file_key, line_no, person_id, det = row
                copies = copies + 1 if obj == last else 1
                line = b"" if copies > 1 else _line(obj, person_id, det)
                if out is None or (copies == 1 and size and size + len(line) > target_bytes):
                    if out is not None:
                        out.close()
                    name, size = f"part-{no:05d}-{uuid.uuid4().hex}.jsonl", 0
                    out = to_fs.open_output_stream(f"{to}/{name}")
                if line and not (begun and obj == low[0]):
                    out.write(line)
                    size += len(line)
                last = obj
                rows.append((no, obj, file_key, line_no, person_id, det, len(line), copies, name))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=_names(_MERGED)).astype({"person_id": "Int64"})
                    rows = []
            if out is not None:
                out.close()
            yield pd.DataFrame(rows, columns=_names(_MERGED)).astype({"person_id": "Int64"})

    ranges = len(bounds) + 1
    merged = cut(spark.range(0, ranges, 1, ranges).mapInPandas(merge, _MERGED))
    if ranges == 1:
        return merged
    # of every range the first and last object may go on: at most two rows a range
    edges = merged.groupBy("range_no").agg(F.min("obj").alias("lo"), F.max("obj").alias("hi"))
    held = merged.join(F.broadcast(edges), "range_no").where("obj = lo or obj = hi").groupBy("range_no", "obj").agg(F.count("*").alias("n"))
    before = held.select("range_no", "obj", F.coalesce(F.sum("n").over(Window.partitionBy("obj").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    stitched = merged.join(F.broadcast(before), ["range_no", "obj"], "left")
    return stitched.withColumn("copy_no", F.col("copy_no") + F.coalesce("before", F.lit(0))).select(*_names(_MERGED))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def consolidated(merged: DataFrame) -> DataFrame:
    """Every object once, with the output file that holds it."""
    return merged.where("copy_no = 1").select("obj", "person_id", "det", "file_key", "n_bytes", "out_file")


def range_metadata(merged: DataFrame) -> DataFrame:
    """Per output file that holds records: records, bytes and the key range it covers."""
    return consolidated(merged).groupBy("out_file").agg(F.count("*").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.min("obj").alias("min_key"), F.max("obj").alias("max_key"))


def files_sharing_objects(merged: DataFrame) -> DataFrame:
    """Pairs of different files that hold a record of one object, from the equal keys of the merged runs."""
    several = merged.where("copy_no > 1").select("obj").distinct()
    held = merged.join(several, "obj", "left_semi").select("obj", "file_key").distinct()
    a, b = held.withColumnRenamed("file_key", "file_key_a"), held.withColumnRenamed("file_key", "file_key_b")
    return a.join(b, "obj").where("file_key_a < file_key_b").select("file_key_a", "file_key_b").distinct()


def write_consolidated(records: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Merge into JSON-line files in ``path/data`` with the range metadata in ``path/ranges``; the metadata."""
    meta = range_metadata(merge_runs(records, target_bytes, f"{path.rstrip('/')}/data"))
    # one row per output file
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/ranges")
    return records.sparkSession.read.parquet(f"{path.rstrip('/')}/ranges")
