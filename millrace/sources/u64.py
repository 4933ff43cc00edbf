"""Headerless little-endian uint64 key files, as a Spark data source ``u64le``.

Batch reads split files into byte ranges and give ``seq``, the row's place over all
files in name order, and ``sk`` as decimal(20, 0) (or long with ``keys=long``).
``limit`` keeps the first rows in file order; a ragged tail is an error.  Batch
writes give a file for each partition, in partition order.

Files are opened by path on the executors, so they must be on a file system that
all of them mount; ``read_records`` reads any store that Spark reads.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.storage import ship

WIDTH = 8
SPLIT_ROWS = 8 << 20
BATCH_ROWS = 1 << 16


def _local(path: str) -> Path:
    plain = path.removeprefix("file://").removeprefix("file:")
    if ":/" in plain:
        raise ValueError(f"{path} isn't on a mounted file system; read_records reads it")
    return Path(plain)


def _files(path: str) -> list[Path]:
    root = _local(path)
    return sorted(p for p in root.iterdir() if p.is_file() and p.name[0] not in "._") if root.is_dir() else [root]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int
    seq: int


class U64Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.long = options["path"], options.get("keys") == "long"
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[Range]:
        out, seq = [], 0
        for file in _files(self.path):
            rows, tail = divmod(os.path.getsize(file), WIDTH)
            if tail:
                raise ValueError(f"{file} ends within a key")
            if self.limit is not None:
                rows = min(rows, max(0, self.limit - seq))
            out += [Range(str(file), a, min(SPLIT_ROWS, rows - a), seq + a) for a in range(0, rows, SPLIT_ROWS)]
            seq += rows
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.first * WIDTH)
            for a in range(0, partition.rows, BATCH_ROWS):
                keys = np.frombuffer(f.read(WIDTH * min(BATCH_ROWS, partition.rows - a)), "<u8")
                if self.long and len(keys) and keys.max() >= 1 << 63:
                    raise ValueError("a key is beyond long; read it as decimal")
                seq = pa.array(np.arange(len(keys)) + partition.seq + a, pa.int64())
                sk = pa.array(keys.astype(np.int64)) if self.long else pa.array(keys, pa.uint64()).cast(pa.decimal128(20, 0))
                yield pa.RecordBatch.from_arrays([seq, sk], ["seq", "sk"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class U64Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        root = _local(self.path)
        if root.exists() and any(root.iterdir()):
            if not overwrite:
                raise FileExistsError(root)
            for file in _files(self.path):
                file.unlink()
        root.mkdir(parents=True, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f".try-{context.partitionId():06d}-{context.taskAttemptId()}"
        n = 0
        with open(_local(self.path) / name, "wb") as f:
            for batch in batches:
                keys = batch.column(0)
                if keys.null_count:
                    raise ValueError("a null is no key")
                f.write(keys.cast(pa.uint64()).to_numpy(zero_copy_only=False).astype("<u8", copy=False).tobytes())
                n += batch.num_rows
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        for k, m in enumerate(x for x in messages if x):
            os.replace(_local(self.path) / m.file, _local(self.path) / f"part-{k:06d}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                (_local(self.path) / m.file).unlink(missing_ok=True)


class U64Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "u64le"

    def schema(self) -> str:
        return f"seq long, sk {'long' if self.options.get('keys') == 'long' else 'decimal(20,0)'}"

    def reader(self, schema: StructType) -> U64Reader:
        return U64Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> U64Writer:
        return U64Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(U64Source)


def read_keys(spark: SparkSession, path: str, limit: int | None = None, long: bool = True) -> DataFrame:
    register(spark)
    reader = spark.read.format("u64le").option("keys", "long" if long else "decimal")
    return (reader.option("limit", limit) if limit is not None else reader).load(path)


def _record_bytes(spark: SparkSession, path: str) -> int:
    """The longest record, of 8 bytes times a power of two up to 64 kB, that divides all files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    sizes = [x.getLen() for x in found if x.isFile() and x.getPath().getName()[0] not in "._"]
    size = 1 << 16
    while any(n % size for n in sizes):
        size //= 2
        if size < WIDTH:
            raise ValueError(f"a file of {path} ends within a key")
    return size


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
        for a in range(0, len(keys), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + BATCH_ROWS], pa.uint64()).cast(pa.decimal128(20, 0))], ["sk"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(sk decimal) of files in any store that Spark reads, in no order; keys come in
    records of as many as the files' sizes allow and are decoded at once."""
    ship(spark)
    records = spark.sparkContext.binaryRecords(path, _record_bytes(spark, path)).map(lambda r: (bytearray(r),))
    return spark.createDataFrame(records, "raw binary").mapInArrow(_decoded, "sk decimal(20,0)")


def write_keys(keys: DataFrame, path: str, column: str = "sk") -> None:
    register(keys.sparkSession)
    keys.select(column).write.format("u64le").mode("append").save(path)
