"""Rows as JSON arrays: the literals of a column by its metadata, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecError
from ..functions.numbers import finite
from ..functions.temporal import deflated, iso_text, realized
from ..functions.text import composable, nfc, to_charset
from ..meta import SPECIAL, TAGS, Dataset, Meta, is_iso_text
from ..types import TEMPORAL


def number_text(c: Column) -> Column:
    """A number as JSON: whole ones without a point, others as they read back exactly."""
    d = c.cast("double")
    return F.when((d % 1 == 0) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(d.cast("string"))


def string_text(c: Column) -> Column:
    """A text as a quoted JSON string."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def literal(c: Column, kind: T.DataType, column: dict) -> Column:
    """One column's values as JSON literals; missing ones are null."""
    want = column["dataType"]
    if want in TEMPORAL and not isinstance(kind, T.StringType):
        numeric = "targetDataType" in column
        if isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        text = number_text(deflated(c, want)) if numeric else string_text(iso_text(c, want))
    elif want in ("integer", "float", "double") and not isinstance(kind, T.StringType):
        text = number_text(c)
    elif want == "boolean" and isinstance(kind, T.BooleanType):
        text = c.cast("string")
    else:
        text = string_text(c.cast("string"))
    return F.coalesce(text, F.lit("null"))


def row_text(x: Dataset, on_invalid: str = "error", tagged: list[str] | None = None) -> DataFrame:
    """One text column: each row as a JSON array, with the tags of columns ``tagged`` behind its cells. Infinite numbers and text that isn't UTF-8 stop it first, in one pass."""
    df, meta = x.df, x.meta
    tests, compose = [], "texts to compose"
    for n in x.names:
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            tests.append((n, "numbers that are not finite", F.count_if(c.isNotNull() & ~finite(c))))
        elif isinstance(kind, T.StringType) and on_invalid == "error":
            tests.append((n, "texts that are not UTF-8", F.count_if(~F.is_valid_utf8(c))))
            tests.append((n, compose, F.count_if(composable(c))))
    row = df.agg(*[t.alias(f"_{i}") for i, (*_, t) in enumerate(tests)]).first() if tests else ()
    bad = [(n, what, row[i]) for i, (n, what, _) in enumerate(tests) if row[i] and what != compose]
    if bad:
        raise CodecError("; ".join(f"{n}: {k} {what}" for n, what, k in bad), columns=[n for n, *_ in bad])
    composed = {n for i, (n, what, _) in enumerate(tests) if row[i] and what == compose}
    cells = []
    for n in x.names:
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, T.StringType):
            c = (nfc(c) if n in composed else c) if on_invalid == "error" else to_charset(F.make_valid_utf8(c), "UTF-8", on_invalid)
        cells.append(literal(c, kind, meta.columns[n]))
    cells += [F.coalesce(string_text(tag_of(n)), F.lit("null")) for n in tagged or []]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("value"))


def tagged_columns(x: Dataset) -> list[str]:
    return [n for n in x.names if f"{SPECIAL}{n}" in x.df.columns]


def tag_of(n: str) -> Column:
    """The tag of a column's special missing value, null where there is none."""
    return F.when(F.col(f"`{n}`").isNull() & F.col(f"`{SPECIAL}{n}`").isin(list(TAGS)), F.col(f"`{SPECIAL}{n}`"))


def special_rows(x: Dataset) -> dict[str, dict[str, list]]:
    """Special missing values of a dataset by column: row numbers from 1, in the order rows are written, and tags.

    Row numbers exist in files only; here they are counted over partitions in order. All tagged cells are collected,
    which a file holds whole in its head: for exchange files; in a folder of parts, tags stand in their rows.
    """
    tagged = tagged_columns(x)
    if not tagged:
        return {}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), tag_of(n).alias("tag")) for n in tagged])
    placed = x.df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), cells.alias("cells"))
    sizes = {r["p"]: r["n"] for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row for each task
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    hits = placed.select("p", (F.col("m") - (F.col("p").cast("long") * F.lit(1 << 33))).alias("i"), F.explode(F.filter("cells", lambda s: s["tag"].isNotNull())).alias("s")).collect()
    out: dict[str, dict[str, list]] = {}
    for r in sorted(hits, key=lambda r: (r["p"], r["i"])):
        o = out.setdefault(r["s"]["column"], {"rows": [], "tags": []})
        o["rows"].append(before[r["p"]] + r["i"] + 1)
        o["tags"].append(r["s"]["tag"])
    return out


def with_special(df: DataFrame, special: dict[str, dict[str, list]], row: str) -> DataFrame:
    """Companion columns from row numbers in the column ``row``; numbers beyond the table are ignored."""
    for n, s in special.items():
        if n in df.columns and s.get("rows"):
            tags = df.sparkSession.createDataFrame([(int(r), t) for r, t in zip(s["rows"], s["tags"], strict=True)], f"{row} long, _tag string")
            df = df.join(tags, row, "left").withColumn(f"{SPECIAL}{n}", F.when(F.col(f"`{n}`").isNull(), F.col("_tag"))).drop("_tag")
    return df


def cells(rows: Column, meta: Meta, where: str, tagged: list[str] | None = None) -> list[Column]:
    """Columns from an array of JSON texts by the metadata; a row of another length is an error when it is read.

    The tags of columns ``tagged`` stand behind the cells. A cell that its column's type can't hold is an error too,
    not a missing value.
    """
    n = len(meta.columns) + len(tagged or [])
    checked = F.when(F.size(rows) == n, rows).otherwise(F.raise_error(F.concat(F.lit(f"{where}: a row has "), F.size(rows).cast("string"), F.lit(f" cells of {n}"))))
    out = []
    for i, (name, c) in enumerate(meta.columns.items()):
        v, want, got = F.get(checked, F.lit(i)), c["dataType"], None
        if want in ("integer", "float", "double"):
            got = v.try_cast("double")
        elif want == "boolean":
            got = v.try_cast("boolean")
        elif want in TEMPORAL and not is_iso_text(c):
            got = F.coalesce(realized(v.try_cast("double"), want, text=False), realized(v, want, text=True))
        if got is not None:
            told = F.concat(F.lit(f"{where}: {name} is of type {want} and can't hold "), F.substring(v, 1, 40))
            v = F.when(got.isNull() & (F.btrim(v) != ""), F.raise_error(told)).otherwise(got)
        out.append(v.alias(name, metadata=c))
    for i, name in enumerate(tagged or [], len(meta.columns)):
        out.append(F.get(checked, F.lit(i)).alias(f"{SPECIAL}{name}"))
    return out


def first_rows(df: DataFrame, n: int, place: list[str]) -> DataFrame:
    """The first n rows in the order of ``place``, the file and the byte where a task's share of it begins, and within that as they are read."""
    order = [*place, "_read"]
    return df.withColumn("_read", F.monotonically_increasing_id()).orderBy(*order).limit(n).drop(*order)


#: Where a row of a file scan stands, for ``first_rows``.
PLACE = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}


def placed(df: DataFrame) -> DataFrame:
    """A file scan with the columns of ``PLACE``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(v).alias(k) for k, v in PLACE.items()])


def narrowed(df: DataFrame, meta: Meta) -> DataFrame:
    """Integer columns as 32-bit where all of their values fit; one that doesn't stays double whole, as readers expect."""
    whole = [n for n, c in meta.columns.items() if c["dataType"] == "integer" and n in df.columns]
    if not whole:
        return df
    big = df.agg(*[F.max(F.abs(F.col(f"`{n}`"))).alias(f"_{i}") for i, n in enumerate(whole)]).first()
    fits = {n for i, n in enumerate(whole) if big[i] is None or big[i] <= 2147483647}
    return df.select(*[(F.col(f"`{c}`").cast("int") if c in fits else F.col(f"`{c}`")).alias(c, metadata=df.schema[c].metadata) for c in df.columns])
