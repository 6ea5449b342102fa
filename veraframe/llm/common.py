"""What the corpus operators share: scratch tables, keys and word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id in join keys; the null itself is returned.
NULL_ID = -(2**63)


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves if driver and executors are one process; on a cluster, where
    executors would each write to a disk of their own, it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='veraframe-')}"
        folder = _local[context.applicationId]
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not a recomputation.

    Operators drop a table when its last reader is written. Those that a result which is still lazy reads stay until
    ``drop`` or the end of the Python process.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self._at_exit)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            delete_path(self.spark, f"{self.path}/{name}".rstrip("/"))
        self.names = [n for n in self.names if names and n not in names]

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self.drop()


def by_place(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by their place, and the names that ``columns`` have there.

    Thus columns with dots in their names, or whose names differ in case alone, do no harm. Of columns of the very
    same name the first is meant.
    """
    have, names = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in have]
    return docs.toDF(*names), [names[have.index(c) if c in have else lower.index(c.lower())] for c in columns]


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Refuse ids that aren't whole numbers."""
    d, (i,) = by_place(docs, id_col)
    kind = dict(d.dtypes)[i]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, not of type {kind}")


def text_of(column: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def doc_key(id_col: str | Column, text_col: str | Column) -> list[Column]:
    """(k_id, k_text): one key for rows of equal id and text, so that a repeated id is no trouble."""
    k = F.col(id_col) if isinstance(id_col, str) else id_col
    return [F.coalesce(k.cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64(text_of(text_col)).alias("k_text")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
