"""Single files written from distributed data, and bytes read from where Spark reads."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError, InputError
from ..functions.text import charset, python_codec


def check_path(path: object) -> str:
    if not isinstance(path, (str, os.PathLike)) or not str(path).strip():
        raise InputError("a path is a text that isn't empty", path=path)
    return str(path)


def local(path: str) -> str:
    """A path that open() takes, on the driver and on executors; other stores are refused."""
    path = path.removeprefix("file://")
    if "://" in path:
        raise CodecError(f"{path}: single files of this format are opened directly; copy it to a shared folder first", path=path)
    return path


def read_range(spark: SparkSession, path: str, offset: int, size: int) -> bytes:
    """Some bytes of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def file_size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


#: Bytes of text in a member of a gzip file.
MEMBER = 8 << 20
_MEMBER = struct.Struct("<2sBBIBBH2sHI")


def gzip_member(data: bytes) -> bytes:
    """A member of a gzip file whose extra field tells its own size, by which readers go from one to the next."""
    z = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = z.compress(data) + z.flush()
    size = _MEMBER.size + len(packed) + 8
    return _MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 8, b"VF", 4, size) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_members(path: str) -> list[tuple[int, int, int]] | None:
    """Offset, size and size of the text of each member of a gzip file in order; None unless all of them tell their sizes."""
    out, at, end = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            head = f.read(_MEMBER.size)
            if len(head) < _MEMBER.size:
                return None
            magic, method, flags, _, _, _, extra, mark, length, size = _MEMBER.unpack(head)
            if (magic, method, flags, extra, mark, length) != (b"\x1f\x8b", 8, 4, 8, b"VF", 4) or size <= _MEMBER.size or at + size > end:
                return None
            f.seek(at + size - 4)
            out.append((at, size, int.from_bytes(f.read(4), "little")))
            at += size
    return out


class _Packed(io.RawIOBase):
    """Packs what is written to a file as members."""

    def __init__(self, out: io.BufferedIOBase) -> None:
        self.out, self.held = out, bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.held += data
        while len(self.held) >= MEMBER:
            self.out.write(gzip_member(bytes(self.held[:MEMBER])))
            del self.held[:MEMBER]
        return len(data)

    def close(self) -> None:
        if not self.closed:
            if self.held:
                self.out.write(gzip_member(bytes(self.held)))
            self.out.close()
        super().close()


def write_one_file(records: DataFrame, path: str, head: bytes = b"", tail: bytes = b"", between: bytes = b"", pad_to: int = 0, pad: bytes = b" ", gz: bool = False) -> int:
    """Write one column of binary or text records to one file, in partition order; the number of records.

    Each task writes a part beside the file, named by its partition, and replaces what a lost attempt left. The driver
    then joins the parts behind the head by copying files, and puts the result in place by a rename: a reader sees the
    whole file or none. With ``gz`` the tasks compress their parts, which are members of the file. For one exchange
    file; a table of cluster size is better written as a folder of parts.
    """
    path = local(check_path(path))
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(parts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = TaskContext.get().partitionId(), 0
        attempt = f"{parts}/{k:08d}.{TaskContext.get().taskAttemptId()}"
        f = open(attempt, "wb")
        with _Packed(f) if gz else f as out:
            for b in batches:
                values = [v if isinstance(v, bytes) else v.encode() for v in b.column(0).to_pylist()]
                if values:
                    out.write((between if n else b"") + between.join(values))
                    n += len(values)
        os.replace(attempt, f"{parts}/{k:08d}.done")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64())], ["k", "n"])

    try:
        counts = {r["k"]: r["n"] for r in records.mapInArrow(write, "k long, n long").collect()}  # a row for each task
        temporary = f"{parts}/whole"
        packed = gzip_member if gz else bytes
        with open(temporary, "wb") as out:
            out.write(packed(head))
            size, first = len(head), True
            for k in sorted(counts):
                if counts[k]:
                    if not first and between:
                        out.write(packed(between))
                        size += len(between)
                    first = False
                    with open(f"{parts}/{k:08d}.done", "rb") as f:
                        shutil.copyfileobj(f, out, 1 << 20)
                    size += Path(f"{parts}/{k:08d}.done").stat().st_size
            if tail:
                out.write(packed(tail))
            size += len(tail)
            if pad_to and size % pad_to:
                out.write(packed(pad * (pad_to - size % pad_to)))
        os.replace(temporary, path)
        return sum(counts.values())
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By content: a compressed file may lack the suffix by which Spark knows it."""
    return read_range(spark, path, 0, 2) == b"\x1f\x8b"


def text_lines(spark: SparkSession, path: str, wholetext: bool = False, encoding: str | None = None) -> DataFrame:
    """The lines of a text file or of those of a folder, or with ``wholetext`` each file as one.

    A file that is compressed without a suffix that says so is unpacked by the task that reads it, as a whole, and so
    is one of another character set than UTF-8: neither can be split at lines, so such a file should fit into memory.
    """
    utf8 = encoding is None or charset(encoding) in ("UTF-8", "US-ASCII")
    plain = path.endswith(".gz") or _is_folder(spark, path) or not is_gzip(spark, path)
    if utf8 and plain:
        return spark.read.text(path, wholetext=wholetext)
    codec = "utf-8" if utf8 else python_codec(charset(encoding or "utf-8"))

    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        return x.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else bytes(b)).decode(codec))

    whole = spark.read.format("binaryFile").load(path).select(decoded("content").alias("value"))
    if wholetext:
        return whole
    lines = whole.select(F.explode(F.split("value", "\r\n|\r|\n")).alias("value"))
    return lines


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise CodecError(f"{path} does not exist", path=path)
    return fs.getFileStatus(where).isDirectory()
