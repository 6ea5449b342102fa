"""NDJSON: metadata on the first line, then a row on each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions.text import charset
from ..meta import Dataset, Meta, as_dataset, parse, payload, stamp
from .files import _is_folder, check_path, text_lines, write_one_file
from .json_rows import PLACE, cells, first_rows, narrowed, placed, row_text, special_rows, tagged_columns, with_special
from .pieces import text_pieces


def write_ndjson(x: Dataset | DataFrame, path: str, on_invalid: str = "error", created: str | None = None, strict: bool = False, layout: str = "file") -> Dataset:
    """Write a dataset; ``layout`` ``parts`` makes a folder of text files that is written and read in parallel.

    ``strict`` leaves out this engine's own block, and with it what the exchange standard has no place for. Tags of
    special missing values stand in the head of a file by row number; in parts, behind the cells of their rows.
    """
    x = as_dataset(x)
    tagged = tagged_columns(x) if layout == "parts" and not strict else []
    special = {"inRows": tagged} if tagged else {} if layout == "parts" or strict else special_rows(x)
    head = payload(x.meta, special, extensions=not strict) | ({"datasetJSONCreationDateTime": created} if created else {})
    line = json.dumps(head, ensure_ascii=False)
    lines = row_text(x, on_invalid, tagged)
    if layout == "parts":
        spark = x.df.sparkSession
        whole = spark.createDataFrame([(line,)], "value string").coalesce(1)
        lines.write.mode("overwrite").text(f"{check_path(path)}/rows")
        whole.write.mode("overwrite").text(f"{path}/head")
    else:
        write_one_file(lines.select(F.concat("value", F.lit("\n")).alias("value")), path, head=f"{line}\n".encode(), gz=str(path).endswith(".gz"))
    return x


def head_of(lines: DataFrame, path: str) -> tuple[Meta, dict, str]:
    """Metadata, special missing values, and the line itself, the first one."""
    first = lines.take(1)
    if not first or not first[0]["value"].lstrip("﻿").startswith("{"):
        raise CodecError(f"{path}: the first line is no metadata", path=path)
    try:
        return *parse(first[0]["value"].lstrip("﻿")), first[0]["value"]
    except (ValueError, KeyError, TypeError) as e:
        raise CodecError(f"{path}: the first line is no metadata: {e}", path=path) from e


def _text() -> Column:
    return F.btrim("value", F.lit(" \t\r\n﻿"))


def row_lines(lines: DataFrame, head: str | None = None) -> DataFrame:
    """Lines without blank ones and without the very line that is the file's ``head``."""
    lines = lines.where(_text() != "")
    return lines if head is None else lines.where(F.col("value") != F.lit(head))


def rows_schema(kept: DataFrame, meta: Meta, where: str, tagged: list[str] | None = None) -> DataFrame:
    """Rows decoded from lines; a line that is no array is an error when it is read."""
    text = _text()
    array = F.from_json(F.when(text.startswith("["), text).otherwise(F.raise_error(F.concat(F.lit(f"{where}: no row: "), F.substring(text, 1, 40)))), "array<string>")
    return kept.select(*[c for c in kept.columns if c != "value"], *cells(array, meta, where, tagged))


def read_ndjson(spark: SparkSession, path: str, col_select: list[str] | None = None, n_max: int | None = None, encoding: str | None = None) -> Dataset:
    """Read a file or a folder of parts. Lines are split over tasks, of a gzip file by members where these tell their sizes; no column is kept that isn't selected.

    The first line of a file is its metadata; any other line that is no row, and any cell that its column can't hold,
    is an error when it is read. ``encoding`` names the character set of a single file, UTF-8 unless given.
    """
    path = check_path(path)
    folder = _is_folder(spark, path)
    every = spark.read.text(f"{path}/rows") if folder else text_pieces(spark, path, encoding) or text_lines(spark, path, encoding=encoding)
    meta, special, head = head_of(spark.read.text(f"{path}/head") if folder else every, path)
    meta = meta.with_dataset(encoding=charset(encoding)) if encoding else meta
    lines = row_lines(every, None if folder else head)
    tagged = special["inRows"] if isinstance(special.get("inRows"), list) else None
    numbered = bool(special) and tagged is None  # tags are by row number, which only the order of lines gives
    if n_max is not None:
        lines = first_rows(placed(lines), n_max, list(PLACE)) if every.inputFiles() else first_rows(lines, n_max, [])
    if numbered:
        # With a bound the lines are few and in order; else they are counted by task, which is in the order of the file.
        lines = lines.rdd.zipWithIndex().map(lambda p: (p[0][0], p[1] + 1)).toDF("value string, _row long")
        df = with_special(rows_schema(lines, meta, path), special, "_row").orderBy("_row").drop("_row")
    else:
        df = rows_schema(lines, meta, path, tagged)
    df = narrowed(df, meta)
    return Dataset(stamp(df, meta), meta)
