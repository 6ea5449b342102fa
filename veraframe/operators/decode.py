"""Codes to their decodes and back, as a lookup without a join."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import CodelistError, CodelistWarning, InputError, warn
from ..functions.numbers import code_text
from ..functions.temporal import trimmed
from ..meta import Dataset, reconcile, stamp
from ..spec import Spec, blank
from .check import offenders
from .conform import coerced

#: Codelists of more entries than this are joined as a table instead of written into the plan.
MOST_ENTRIES = 2000


def mapping(spec: Spec, codelist_id: str, direction: str) -> dict[str, str]:
    """From term to decode or back; of repeated keys the first counts."""
    a, b = ("term", "decode") if direction == "to_decode" else ("decode", "term")
    out: dict[str, str] = {}
    for c in spec.codelist(codelist_id):
        if c[a] is not None and c[b] is not None:
            out.setdefault(c[a], c[b])
    return out


def _soft(table: dict[str, str], trim: bool, ignore_case: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in table.items():
        k = k.strip(" \t\r\n") if trim else k
        out.setdefault(k.upper() if ignore_case else k, v)
    return out


def _literal(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]) if table else F.create_map().cast("map<string,string>")


def decode_column(x: DataFrame | Dataset, spec: Spec, dataset: str, source: str, to: str | None = None, direction: str = "to_decode", no_match: str = "error", trim: bool = True, ignore_case: bool = False) -> DataFrame | Dataset:
    """Add or overwrite column ``to`` with the decodes (or terms) of ``source``'s values.

    An exact match counts before one after trimming or ignoring case, which is warned of. Missing values stay so. Other
    values stop it, stay as they are, or become missing, as ``no_match`` says. The codelist is that of ``to``, or else
    of ``source``; a declared ``to`` gets its data type and label.
    """
    to = to or source
    if direction not in ("to_decode", "to_code") or no_match not in ("error", "keep", "na"):
        raise InputError("direction is to_decode or to_code, no_match error, keep or na")
    df = x.df if isinstance(x, Dataset) else x
    if source not in df.columns:
        raise InputError(f"no column {source!r}", column=source)
    declared = [spec.variable(dataset, n) for n in (to, source)]
    codelist = next((v["codelist_id"] for v in declared if v and not blank(v["codelist_id"])), None)
    if codelist is None:
        raise CodelistError(f"neither {to} nor {source} has a codelist", variable=source)
    exact = mapping(spec, codelist, direction)
    soft = _soft(exact, trim, ignore_case) if trim or ignore_case else {}
    kind = df.schema[source].dataType
    value = code_text(F.col(f"`{source}`"), kind.simpleString())
    key = trimmed(value) if trim else value
    key = F.upper(key) if ignore_case else key
    first, second = F.element_at(_literal(exact), value), F.element_at(_literal(soft), key) if soft else F.lit(None).cast("string")
    if len(exact) > MOST_ENTRIES:
        spark = df.sparkSession
        a = spark.createDataFrame(list(exact.items()), "_k1 string, _v1 string")
        b = spark.createDataFrame(list(soft.items()), "_k2 string, _v2 string")
        df_joined = df.join(a, value == F.col("_k1"), "left").join(b, key == F.col("_k2"), "left")
        first, second = F.col("_v1"), F.col("_v2")
    else:
        df_joined = df
    unmatched = value.isNotNull() & first.isNull() & second.isNull()
    softly, none = (int(n or 0) for n in df_joined.agg(F.count_if(value.isNotNull() & first.isNull() & second.isNotNull()), F.count_if(unmatched)).first())
    if none and no_match == "error":
        n, sample = offenders(df_joined, {"x": (value, unmatched)})["x"]
        raise CodelistError(f"{source}: {n} distinct values have no entry in {codelist}: {', '.join(sample)}", variable=source, values=sample, n=n)
    if softly:
        warn(CodelistWarning, f"{source}: {softly} values matched {codelist} only after trimming or ignoring case")
    new = F.coalesce(first, second, *([value] if no_match == "keep" else []))
    v = declared[0]
    if v is not None and v["data_type"] in ("integer", "float", "double", "boolean"):
        new = coerced(new, StringType(), v["data_type"])
    metadata = {"label": v["label"]} if v is not None and v["label"] else {}
    out = df_joined.withColumn(to, new)
    out = out.select(*[F.col(f"`{c}`").alias(c, metadata=metadata) if c == to and metadata else F.col(f"`{c}`") for c in ([*df.columns] if to in df.columns else [*df.columns, to])])
    if isinstance(x, Dataset):
        meta = reconcile(x.meta, out)
        return Dataset(stamp(out, meta), meta, x.findings)
    return out

