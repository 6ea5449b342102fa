"""Parquet with the dataset's metadata beside its schema."""

from __future__ import annotations

import io
from dataclasses import replace

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError, InputError
from ..functions.text import charset, composable, encodable, nfc, to_charset
from ..meta import Dataset, as_dataset, meta_from_frame, parse, reconcile, stamp, to_json
from .files import check_path, file_size, read_range
from .json_rows import PLACE, first_rows, placed

COMPRESSIONS = ("snappy", "gzip", "zstd", "uncompressed")
#: Fixed value: the key of a footer under which exchange metadata stand.
FOOTER_KEY = b"metadata_json"
#: The folder of the metadata, beside the part files; its leading underscore hides it from scans.
SIDECAR = "_meta"


def write_parquet(x: Dataset | DataFrame, path: str, compression: str = "snappy", on_invalid: str = "error", mode: str = "overwrite", encoding: str | None = None) -> Dataset:
    """Write a folder of parts; companion columns of special missing values are columns like others.

    Text is UTF-8 in any Parquet file; ``encoding`` names the character set that the metadata tell of, and that texts
    must fit into.
    """
    if compression not in COMPRESSIONS:
        raise InputError(f"compression is one of {', '.join(COMPRESSIONS)}", compression=compression)
    x = as_dataset(x)
    spark, df = x.df.sparkSession, x.df
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    composed: set[str] = set(texts)
    if on_invalid == "error" and texts:
        cols = [F.col(f"`{n}`") for n in texts]
        told = df.agg(*[F.count_if(~F.is_valid_utf8(c)) for c in cols], *[F.bool_or(composable(c)) for c in cols]).first()
        bad = [n for n, k in zip(texts, told, strict=False) if k]
        if bad:
            raise CodecError(f"texts that are not UTF-8: {', '.join(bad)}", columns=bad)
        composed = {n for n, k in zip(texts, told[len(texts) :], strict=True) if k}

    def clean(n: str) -> Column:
        c = F.col(f"`{n}`")
        if on_invalid != "error":
            return to_charset(F.make_valid_utf8(c), encoding or "UTF-8", on_invalid)
        return nfc(c) if n in composed else c

    if encoding is not None:
        x = replace(x, meta=x.meta.with_dataset(encoding=charset(encoding)))
        if on_invalid == "error" and texts and charset(encoding) != "UTF-8":
            fits = encodable(encoding)
            told = df.agg(*[F.count_if(~fits(F.col(f"`{n}`"))) for n in texts]).first()
            bad = [n for n, k in zip(texts, told, strict=True) if k]
            if bad:
                raise CodecError(f"texts that {charset(encoding)} lacks characters of: {', '.join(bad)}", columns=bad)
    df = df.select(*[(clean(f.name) if f.name in texts else F.col(f"`{f.name}`")).alias(f.name, metadata=f.metadata) for f in df.schema.fields])
    df.write.mode(mode).option("compression", compression).parquet(check_path(path))
    spark.createDataFrame([(to_json(x.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{SIDECAR}")
    return x


def read_parquet(spark: SparkSession, path: str, col_select: list[str] | None = None, n_max: int | None = None, encoding: str | None = None) -> Dataset:
    """Read a table. Its text is UTF-8; ``encoding`` only sets the character set that the metadata tell of. Metadata come from the sidecar, or from a file's footer as other writers put them there, or from the fields' own, or else are inferred."""
    df = spark.read.parquet(check_path(path))
    try:
        meta = parse(spark.read.text(f"{path}/{SIDECAR}").first()["value"])[0]
    except Exception as e:  # no sidecar: Spark has no narrower class for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        told = footer(spark, df.inputFiles()[0] if df.inputFiles() else None)
        meta = reconcile(parse(told)[0], df) if told else meta_from_frame(df)
    meta = meta.with_dataset(encoding=charset(encoding)) if encoding else meta
    if n_max is not None:
        df = first_rows(placed(df), n_max, list(PLACE))
    return Dataset(stamp(df, meta), meta)


def footer(spark: SparkSession, path: str | None) -> str | None:
    """The metadata that a Parquet file's footer holds under FOOTER_KEY; a few kilobytes are read, from wherever Spark reads."""
    if path is None:
        return None
    n = file_size(spark, path)
    size = int.from_bytes(read_range(spark, path, n - 8, 8)[:4], "little")
    # The footer alone, as a file that has nothing else.
    whole = pq.read_metadata(io.BytesIO(b"PAR1" + read_range(spark, path, n - 8 - size, size + 8)))
    told = (whole.metadata or {}).get(FOOTER_KEY)
    return told.decode() if told else None


def write_checkpoint(x: Dataset, path: str) -> Dataset:
    """This engine's own lossless form, in place of a serialised object of another language."""
    return write_parquet(x, path, compression="zstd")


def read_checkpoint(spark: SparkSession, path: str) -> Dataset:
    return read_parquet(spark, path)
