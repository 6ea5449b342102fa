"""Dataset-JSON 1.1: one document with metadata and rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions.text import charset
from ..meta import Dataset, as_dataset, parse, payload, stamp
from .files import check_path, text_lines, write_one_file
from .json_rows import cells, narrowed, row_text, special_rows, with_special
from .pieces import document, pieces


def write_json(x: Dataset | DataFrame, path: str, on_invalid: str = "error", created: str | None = None, strict: bool = False) -> Dataset:
    """Write one document: the head on the driver, a line for each row from the tasks."""
    x = as_dataset(x)
    head = payload(x.meta, special_rows(x), extensions=not strict) | ({"datasetJSONCreationDateTime": created} if created else {})
    start = json.dumps(head, ensure_ascii=False)[:-1] + ', "rows": [\n'
    write_one_file(row_text(x, on_invalid), path, head=start.encode(), tail=b"\n]}\n", between=b",\n", gz=str(path).endswith(".gz"))
    return x


def read_json(spark: SparkSession, path: str, col_select: list[str] | None = None, n_max: int | None = None, encoding: str | None = None) -> Dataset:
    """Read one document, in the character set ``encoding``, UTF-8 unless given.

    Tasks read pieces of a file that they can open by its path, and find rows by brackets and quotes; a file that is
    compressed by another writer or of another character set is one stream. In other stores one task parses the document whole (2 GB at
    most). The driver sees the metadata, never the rows.
    """
    path = check_path(path)
    p = pieces(path, encoding)
    doc = document(spark, p) if p else None
    head, whole = (doc.head, None) if doc else _whole(spark, path, encoding)
    try:
        meta, special = parse({k: v for k, v in head.items() if k != "rows"})
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CodecError(f"{path}: bad metadata: {e}", path=path) from e
    meta = meta.with_dataset(encoding=charset(encoding)) if encoding else meta
    unread = F.raise_error(F.lit(f"{path}: rows can't be read"))
    if doc:
        rows = doc.lines(spark, n_max, bool(special)).select("_row", F.coalesce(F.from_json("value", "array<string>"), unread.cast("array<string>")).alias("cells"))
    else:
        array = F.from_json(F.coalesce(F.get_json_object("value", "$.rows"), F.lit("[]")), "array<array<string>>")
        rows = whole.select(F.posexplode(F.coalesce(array, unread)).alias("_row", "cells")).withColumn("_row", F.col("_row").cast("long") + 1)
    df = rows.select("_row", *cells(F.col("cells"), meta, path))
    df = with_special(df, special, "_row") if special else df
    df = (df.orderBy("_row") if special or n_max is not None else df).drop("_row")
    df = df.limit(n_max) if n_max is not None else df
    return Dataset(stamp(narrowed(df, meta), meta), meta)


def _whole(spark: SparkSession, path: str, encoding: str | None) -> tuple[dict, DataFrame]:
    """The head of a document that one task holds whole, and its text."""
    text = F.ltrim("value", F.lit("﻿"))
    doc = text_lines(spark, path, wholetext=True, encoding=encoding).select(text.alias("value"))
    first = doc.select(F.json_object_keys("value").alias("keys"), F.contains(F.col("value"), F.lit("\x00")).alias("nul")).first()
    if first is None or first["keys"] is None or "columns" not in first["keys"] or first["nul"]:
        raise CodecError(f"{path} is no Dataset-JSON document", path=path)
    names = [k for k in first["keys"] if k != "rows"]
    got = doc.select(*[F.get_json_object("value", f"$['{k}']").alias(f"_{i}") for i, k in enumerate(names)]).first()
    return {k: _value(got[i]) for i, k in enumerate(names)}, doc


def _value(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text
