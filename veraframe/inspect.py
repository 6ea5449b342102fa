"""What is in a dataset, a file or a folder."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Condition, InputError
from .functions.text import ENCODINGS
from .meta import Dataset, as_dataset, is_iso_text
from .sources import io, xpt
from .sources.files import check_path, local
from .types import TEMPORAL, TEXT


@dataclass(frozen=True)
class Pane:
    """Rows of (number, variable, type, length, format, informat, label, key)."""

    name: str
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "n int, variable string, type string, len int, format string, informat string, label string, key int")

    def __str__(self) -> str:
        head = ("#", "Variable", "Type", "Len", "Format", "Informat", "Label", "Key")
        table = [head, *(tuple("" if x is None else str(x) for x in r) for r in self.rows)]
        keep = [i for i in range(len(head)) if i != 5 or any(r[5] for r in table[1:])]
        wide = [max(len(r[i]) for r in table) for i in range(len(head))]
        return "\n".join([self.name, *("  ".join(r[i].ljust(wide[i]) for i in keep).rstrip() for r in table)])


def columns(x: DataFrame | Dataset) -> Pane:
    """Each column's type (Char or Num), length, formats, label and place in the key.

    Lengths of text that nothing declares are the longest value's bytes: one aggregate for all such columns.
    """
    x = as_dataset(x)
    char = {n: c["dataType"] in TEXT or isinstance(x.df.schema[n].dataType, T.StringType) or is_iso_text(c) and c["dataType"] in TEMPORAL for n, c in x.meta.columns.items()}
    ask = [n for n, c in x.meta.columns.items() if char[n] and "length" not in c]
    got = x.df.agg(*[F.coalesce(F.max(F.octet_length(F.col(f"`{n}`").cast("string"))), F.lit(0)).alias(f"_{i}") for i, n in enumerate(ask)]).first() if ask else []
    size = dict(zip(ask, got, strict=True))
    rows = [(i, n, "Char" if char[n] else "Num", c.get("length", size.get(n, 8)), c.get("displayFormat"), c.get("informat"), c.get("label"), c.get("keySequence")) for i, (n, c) in enumerate(x.meta.columns.items(), 1)]
    return Pane(x.meta.dataset["name"], tuple(rows))


_MEMBERS = "file string, member string, label string, records long, variables int, format string"


def _of_file(spark: SparkSession, path: str, codec: io.Codec) -> list[tuple]:
    name = os.path.basename(path.rstrip("/"))
    if codec.name == "xpt":
        return [(name, m.name, m.label or None, m.rows, len(m.variables), "xpt") for m in xpt.members_of(path)]
    x = codec.read(spark, path)
    records = x.meta.dataset.get("records")
    if records is None:
        records = x.df.count()  # of Parquet, from its footers
    return [(name, x.meta.dataset["name"], x.meta.dataset.get("label"), int(records), len(x.meta.columns), codec.name)]


def members(spark: SparkSession, path: str) -> DataFrame:
    """Datasets of a file, or of all files of a folder whose extension is known, by file and member; a damaged one is an error."""
    path = local(check_path(path))
    if not os.path.exists(path):
        raise InputError(f"{path} does not exist", path=path)
    known = None
    try:
        known = io.by_extension(path)
    except Condition:
        if not os.path.isdir(path):
            raise
    rows: list[tuple] = []
    if known is not None:
        rows = _of_file(spark, path, known)
    else:
        for f in sorted(os.listdir(path), key=lambda f: f.encode()):
            try:
                codec = io.by_extension(f)
            except Condition:
                continue
            rows += _of_file(spark, f"{path}/{f}", codec)
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0].encode(), r[1].encode())), _MEMBERS)


def xpt_members(spark: SparkSession, path: str) -> DataFrame:
    """member, name, label, nvars, nobs."""
    rows = [(i, m.name, m.label or None, len(m.variables), m.rows) for i, m in enumerate(xpt.members_of(path), 1)]
    return spark.createDataFrame(rows, "member int, name string, label string, nvars int, nobs long")


def encodings(spark: SparkSession) -> DataFrame:
    """One character set by its names in R, SAS and Python."""
    return spark.createDataFrame(list(ENCODINGS), "r string, sas string, python string, description string")
