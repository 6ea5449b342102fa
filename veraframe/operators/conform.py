"""Make a dataset agree with its specification: coerce, order, sort, stamp, check."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CoercionWarning, ConformanceError, ConformanceWarning, InputError, OrderWarning, TypeVocabularyError, inform, warn
from ..functions.numbers import finite, shortest_text
from ..functions.temporal import iso_text, realized, trimmed
from ..meta import SPECIAL, Dataset, Meta, meta_from_spec, reconcile, resolve_targets, stamp
from ..rules import report
from ..spec import Row, Spec
from ..types import SPARK_TYPES, TEMPORAL, storage
from .check import INT_MAX, Checks, check_spec

_YES, _NO = ["TRUE", "T", "Y", "YES", "1"], ["FALSE", "F", "N", "NO", "0"]


def as_number(c: Column, kind: T.DataType) -> Column:
    """A value as a double; text that is no number is null."""
    s = storage(kind)
    if s == "character":
        return trimmed(c).try_cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        from ..functions.temporal import deflated

        name = {T.DateType: "date", T.DayTimeIntervalType: "time"}.get(type(kind), "datetime")
        return deflated(c.cast("timestamp_ntz") if name == "datetime" else c, name)
    return c.cast("int").cast("double") if s == "logical" else c.cast("double")


def coerced(c: Column, kind: T.DataType, want: str) -> Column:
    """A column cast to the storage of a data type. Casts never fail: what doesn't fit is null.

    Text that is a number becomes an integer by dropping its fraction; the caller counts such losses first.
    """
    s = storage(kind)
    if want in ("string", "URI"):
        if s == "double" and isinstance(kind, (T.DoubleType, T.FloatType)):
            return shortest_text(c.cast("double"))
        if isinstance(kind, T.DateType):
            return iso_text(c, "date")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return iso_text(c.cast("timestamp_ntz"), "datetime")
        return F.upper(c.cast("string")) if s == "logical" else c.cast("string")
    if want == "decimal":
        return c.cast("string") if s == "character" else shortest_text(as_number(c, kind))
    if want == "boolean":
        if s == "character":
            t = F.upper(trimmed(c))
            return F.when(t.isin(_YES), True).when(t.isin(_NO), False)
        return c if s == "logical" else F.when(finite(as_number(c, kind)), as_number(c, kind) != 0)
    d = as_number(c, kind)
    if want == "integer":
        return F.when(finite(d) & (F.abs(d) <= INT_MAX), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("int"))
    return d


def coerced_temporal(c: Column, kind: T.DataType, v: Row, whole_column: bool) -> Column:
    """A temporal column: Spark's own type is kept, numbers count from the epoch, text is read only if all of it can be."""
    want = v["data_type"]
    if storage(kind) == "character":
        return realized(c, want, text=True) if v["target_data_type"] and whole_column else c
    if storage(kind) in ("integer", "double") and not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return realized(c.cast("double"), want, text=False)
    return c.cast("timestamp_ntz") if want == "datetime" and isinstance(kind, (T.TimestampType, T.DateType)) else c.cast(SPARK_TYPES[want]) if want == "date" else c


def coercion_tally(df: DataFrame, spec: Spec, dataset: str) -> list[Row]:
    """What casting would lose: variable, data_type, n and reason (truncated, overflowed, na_introduced), in one aggregate.

    ``unread`` rows, for a temporal text column that can't be read whole, are no loss: such a column stays text.
    """
    exprs: list[tuple[str, str, str, Column]] = []
    fields = {f.name: f for f in df.schema.fields}
    for v in spec.variables_of(dataset):
        n, want = v["variable"], v["data_type"]
        if n not in fields:
            continue
        c, kind = F.col(f"`{n}`"), fields[n].dataType
        present = c.isNotNull() & ((trimmed(c) != "") if storage(kind) == "character" else F.lit(True))
        if want in TEMPORAL:
            if storage(kind) == "character" and v["target_data_type"]:
                exprs.append((n, want, "unread", present & realized(c, want, text=True).isNull()))
            continue
        new = coerced(c, kind, want)
        if want == "integer":
            d = as_number(c, kind)
            exprs.append((n, want, "truncated", finite(d) & (d % 1 != 0) & (F.abs(d) <= INT_MAX)))
            exprs.append((n, want, "overflowed", finite(d) & (F.abs(d) > INT_MAX)))
            exprs.append((n, want, "na_introduced", present & ~finite(d)))
        elif want not in ("string", "URI"):
            exprs.append((n, want, "na_introduced", present & new.isNull()))
    if not exprs:
        return []
    row = df.agg(*[F.count_if(e).alias(f"_{i}") for i, (*_, e) in enumerate(exprs)]).first()
    return [{"variable": n, "data_type": t, "n": int(row[i]), "reason": r} for i, (n, t, r, _) in enumerate(exprs) if row[i]]


def coerce(df: DataFrame, spec: Spec, dataset: str, on_loss: str = "error") -> tuple[DataFrame, list[Row]]:
    """All declared columns cast in one projection, and what was lost. Truncation and overflow stop it before any cast."""
    tally = coercion_tally(df, spec, dataset)
    lossy = [t for t in tally if t["reason"] in ("truncated", "overflowed")]
    if lossy and on_loss == "error":
        raise TypeVocabularyError("casting would lose values: " + "; ".join(f"{t['variable']} ({t['n']} {t['reason']})" for t in lossy), variables=lossy)
    unread = {t["variable"] for t in tally if t["reason"] == "unread"}
    lost = [t for t in tally if t["reason"] == "na_introduced"]
    if lost:
        warn(CoercionWarning, "values became missing: " + "; ".join(f"{t['variable']} ({t['n']})" for t in lost))
    columns = []
    for f in df.schema.fields:
        c, v = F.col(f"`{f.name}`"), spec.variable(dataset, f.name)
        if v is None:
            columns.append(c)
        elif v["data_type"] in TEMPORAL:
            columns.append(coerced_temporal(c, f.dataType, v, f.name not in unread).alias(f.name))
        else:
            columns.append(coerced(c, f.dataType, v["data_type"]).alias(f.name))
    return df.select(*columns), [t for t in tally if t["reason"] != "unread"]


def order_columns(df: DataFrame, spec: Spec, dataset: str) -> DataFrame:
    """Declared variables by their order, then the others."""
    declared = [v["variable"] for v in spec.ordered(dataset) if v["variable"] in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*declared, *(c for c in df.columns if c not in declared)]])


def sort_keys(df: DataFrame, keys: list[str], na_position: str = "first", tie: str | None = None) -> DataFrame:
    """Rows by key: text by its bytes, missing values and NaN first or last. A ``tie`` column keeps equal keys in order."""
    if na_position not in ("first", "last"):
        raise InputError("na_position is first or last", na_position=na_position)
    by = []
    for k in keys:
        if k in df.columns:
            c = F.col(f"`{k}`")
            c = F.when(~F.isnan(c), c) if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)) else c
            by.append(c.asc_nulls_first() if na_position == "first" else c.asc_nulls_last())
    return df.orderBy(*by, *([tie] if tie else [])) if by else df


def stamp_meta(df: DataFrame, spec: Spec, dataset: str) -> tuple[DataFrame, Meta]:
    """Metadata from the specification for the columns that are there; others are inferred."""
    meta = resolve_targets(reconcile(meta_from_spec(spec, dataset), df), df)
    return stamp(df, meta), meta


def apply_spec(x: DataFrame | Dataset, spec: Spec, dataset: str, conformance: str = "warn", na_position: str = "first", extra: str = "keep", on_coercion_loss: str = "error", checks: Checks | None = None, tie: str | None = None) -> Dataset:
    """A conformed dataset with its metadata and findings.

    Never fabricates a column: a declared variable that the data lack is reported. ``conformance`` ``abort`` stops on
    findings of severity error, ``warn`` warns of errors and warnings, ``off`` doesn't check.
    """
    for name, value, allowed in (("conformance", conformance, ("warn", "abort", "off")), ("extra", extra, ("keep", "drop")), ("on_coercion_loss", on_coercion_loss, ("error", "keep"))):
        if value not in allowed:
            raise InputError(f"{name} is one of {', '.join(allowed)}", argument=name)
    df = x.df if isinstance(x, Dataset) else x
    declared = [v["variable"] for v in spec.variables_of(dataset)]
    numbered = {v["order"] is not None for v in spec.variables_of(dataset)}
    if numbered == {True, False}:
        warn(OrderWarning, f"{dataset}: variables without an order trail the others")
    missing = [n for n in declared if n not in df.columns]
    if missing:
        inform("apply", f"{dataset}: not in the data: {', '.join(missing)}")
    df, _ = coerce(df, spec, dataset, on_coercion_loss)
    if extra == "drop":
        gone = [c for c in df.columns if c not in declared and not c.startswith(SPECIAL)]
        if gone:
            inform("apply", f"{dataset}: dropped {', '.join(gone)}")
            df = df.drop(*gone)
    df, meta = stamp_meta(order_columns(df, spec, dataset), spec, dataset)
    # The checks don't hang on the rows' order, so they read the frame before it is sorted.
    found = [] if conformance == "off" else check_spec(Dataset(df, meta), spec, dataset, checks=checks)
    out = Dataset(sort_keys(df, spec.keys(dataset), na_position, tie), meta, tuple(found))
    if conformance == "off":
        return out
    errors = [f for f in found if f.severity == "error"]
    if conformance == "abort" and errors:
        raise ConformanceError(report(errors, f"{dataset} does not conform"), findings=found)
    if any(f.severity != "note" for f in found):
        warn(ConformanceWarning, report([f for f in found if f.severity != "note"], f"{dataset} does not conform"))
    return out


def conformance(x: Dataset) -> list:
    """The findings that conforming a dataset left with it."""
    return list(x.findings)
