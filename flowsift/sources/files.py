"""Facts about source files, found in tasks: listing, header lines and digests.

Where the scheme is one of ``DIRECT``, the task that has a file reads its bytes as a stream: a header costs the first
lines only, and a digest is of a file of any size. Files of any other store are read by Spark's own readers, with the
same results: headers then cost a scan, and a digest needs the whole file in one row (below 2 GB).
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators.staging import staged

#: A first line longer than this is no header.
LONGEST_HEADER = 1 << 20
PIECE = 1 << 22
#: Schemes whose files a task opens by itself.
DIRECT = ("file", "s3", "s3a", "s3n", "gs")
#: Bytes of a table of one row a file that may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def _folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def listed(spark: SparkSession, folder: str, *endings: str) -> DataFrame:
    """load_path, path (as rows of a scan name it) and length of the files below a folder, or of one file.

    ``endings`` are endings of a name, or parts of it if they close with ``*``. No file is opened. A scan has
    no row of a file without bytes; ``names`` has it.
    """
    files = _folder(spark, folder)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    fits = [name.contains(e[:-1]) if e.endswith("*") else name.endswith(e) for e in endings]
    return files.select(F.col("path").alias("load_path"), F.col("_metadata.file_path").alias("path"), "length").filter(reduce(lambda a, b: a | b, fits))


def names(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """path of the files below a folder by ending, those without bytes too."""
    found = _folder(spark, folder).inputFiles()
    return sorted(p.replace("file:///", "file:/", 1) for p in found if p.endswith(ending))


def open_file(path: str, compression: str | None = None):
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    store, place = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return store.open_input_stream(place, compression=compression)


def _with_fact(
    files: DataFrame, name: str, fact: Callable[[str], str | None], scanned: Callable[[SparkSession, list[str]], DataFrame], direct: tuple[str, ...],
) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fact(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("load_path"), batch.column("path"), found], names=["load_path", "path", name])

    files = files.select("load_path", "path")
    opens = F.substring_index("path", ":", 1).isin(*direct)
    facts = files.filter(opens).mapInArrow(rows, f"load_path string, path string, {name} string")
    others = [r["load_path"] for r in files.filter(~opens).select("load_path").collect()]
    if others:
        facts = facts.unionByName(files.filter(~opens).join(scanned(files.sparkSession, others), "path", "left"))
    return facts


def header_lines(files: DataFrame, mark: str = "", direct: tuple[str, ...] = DIRECT) -> DataFrame:
    """load_path, path and the first line that starts with ``mark``; null where there is none."""
    sign = mark.encode()

    def first(path: str) -> str | None:
        with open_file(path, "detect") as raw, io.BufferedReader(raw, 1 << 16) as lines:
            begins = True
            while line := lines.readline(LONGEST_HEADER):
                if begins and line.startswith(sign):
                    short = len(line) < LONGEST_HEADER or line.endswith(b"\n")
                    return line.decode("utf-8", "replace").rstrip("\r\n") if short else None
                begins = line.endswith(b"\n")
        return None

    def scanned(spark: SparkSession, paths: list[str]) -> DataFrame:
        place: Column = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), place.alias("place"))
        head = F.min_by("value", "place")
        return lines.filter(F.col("value").startswith(mark)).groupBy("path").agg(F.when(F.octet_length(head) < LONGEST_HEADER, head).alias("header"))

    return _with_fact(files, "header", first, scanned, direct)


def file_hashes(files: DataFrame, direct: tuple[str, ...] = DIRECT) -> DataFrame:
    """load_path, path and SHA-256 of the bytes of each file."""
    def digest(path: str) -> str:
        seen = hashlib.sha256()
        with open_file(path) as raw:
            while piece := raw.read(PIECE):
                seen.update(piece)
        return seen.hexdigest()

    def scanned(spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(paths).select(
            F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))

    return _with_fact(files, "sha256", digest, scanned, direct)


def for_join(per_file: DataFrame) -> DataFrame:
    """A table of one row a file, written once and marked for broadcast if its measured size allows."""
    table = staged(per_file)
    size = table.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c in table.columns), F.lit(0)))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table
