"""Does a dataset agree with its specification? Eighteen checks as one fused aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions.numbers import code_text, finite
from ..functions.temporal import is_blank, iso_ok, trimmed
from ..meta import SPECIAL, Dataset
from ..rules import Finding, finding
from ..spec import Row, Spec, blank
from ..types import TEMPORAL, WANTED, family, storage

#: Offending values that a message names.
SAMPLES = 5
#: Bytes of a text value and of a label, characters of a name.
TEXT_LIMIT, LABEL_LIMIT, NAME_LIMIT, LONG_NAME = 200, 40, 8, 32
INT_MAX = 2147483647


@dataclass(frozen=True)
class Checks:
    """Which of the eighteen checks run; all do unless switched off."""

    missing_variable: bool = True
    missing_permissible: bool = True
    extra_variable: bool = True
    variable_name: bool = True
    dataset_name: bool = True
    invalid_encoding: bool = True
    type_mismatch: bool = True
    iso8601_format: bool = True
    length_overflow: bool = True
    char_length_limit: bool = True
    integer_fraction: bool = True
    integer_overflow: bool = True
    label_length: bool = True
    label_match: bool = True
    codelist_membership: bool = True
    codelist_membership_extensible: bool = True
    display_format: bool = True
    key_uniqueness: bool = True

    def __post_init__(self) -> None:
        bad = [f.name for f in fields(self) if not isinstance(getattr(self, f.name), bool)]
        if bad:
            raise InputError(f"toggles are true or false: {', '.join(bad)}", toggles=bad)

    def __str__(self) -> str:
        return "\n".join(f"{f.name}: {'on' if getattr(self, f.name) else 'off'}" for f in fields(self))


def is_checks(x: object) -> bool:
    return isinstance(x, Checks)


def mandatory(v: Row) -> bool:
    """A variable whose flag is missing or says anything but no is mandatory."""
    x = v.get("mandatory")
    return str(x).strip().upper() not in ("N", "NO", "FALSE", "0") if isinstance(x, str) else x is None or bool(x)


def name_problem(name: str) -> str | None:
    """The worst thing wrong with a name, for a transport file."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        return "has characters other than letters, digits and underscores"
    if len(name) > LONG_NAME:
        return f"is longer than {LONG_NAME} characters"
    return f"is longer than {NAME_LIMIT} characters" if len(name) > NAME_LIMIT else None


def terms_of(spec: Spec, v: Row, decode: str) -> tuple[list[str], bool]:
    """Trimmed terms (or decodes) that a variable's values are held against, and whether others may be added."""
    rows = [c for c in spec.codelists if c["codelist_id"] == v["codelist_id"]]
    texts = [c["decode" if decode == "to_decode" else "term"] for c in rows]
    return list(dict.fromkeys(t.strip(" \t\r\n") for t in texts if t is not None)), any(c["extended"] for c in rows)


def outside(c: Column, terms: list[str], required: bool) -> Column:
    """Whether a value is none of the terms; missing and blank ones are only if the variable is required."""
    t = trimmed(c)
    listed = t.isin(terms) if terms else F.lit(False)
    return F.when(is_blank(c), F.lit(required) & ~F.coalesce(listed, F.lit(False))).otherwise(~listed)


def offenders(df: DataFrame, tests: dict[str, tuple[Column, Column]]) -> dict[str, tuple[int, list[str]]]:
    """For each name of (value, is bad): how many distinct bad values, and the first of them in byte order.

    One pass over the data for all names: its distinct bad values are kept for the two jobs that count them and take
    the first of them; only samples reach the driver.
    """
    if not tests:
        return {}
    pairs = F.array(*[F.when(bad, F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit("<NA>")).alias("value"))) for k, (v, bad) in tests.items()])
    found = df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("p.name", "p.value").distinct().persist()
    by = Window.partitionBy("name").orderBy("value")
    few = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= SAMPLES)
    counts = {r["name"]: r["n"] for r in found.groupBy("name").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in few.orderBy("name", "rank").collect():
        samples[r["name"]].append(r["value"])
    found.unpersist()
    return {k: (n, samples[k]) for k, n in counts.items()}


def duplicated_rows(df: DataFrame, keys: list[str]) -> int:
    """Rows in groups of one key that have more than one row; missing values are equal to each other."""
    n = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.sum("_n")).first()[0]
    return int(n or 0)


class _Plan:
    """Aggregates of one pass over the data, by a name for each."""

    def __init__(self) -> None:
        self.exprs: dict[str, Column] = {}
        self.got: dict[str, int] = {}

    def add(self, name: str, expr: Column) -> None:
        self.exprs[name] = expr

    def run(self, df: DataFrame) -> None:
        if self.exprs:
            names = list(self.exprs)
            row = df.agg(*[self.exprs[n].alias(f"_{i}") for i, n in enumerate(names)]).first()
            self.got = {n: int(row[i] or 0) for i, n in enumerate(names)}


def check_spec(x: DataFrame | Dataset, spec: Spec, dataset: str, decode: str = "none", checks: Checks | None = None) -> list[Finding]:
    """Findings of a dataset against its specification, in a fixed order.

    Three passes at most, however many variables: one aggregate of all counts and lengths, one for the distinct values
    of the columns found to offend, and one by key. ``decode`` says whether coded columns hold terms or decodes.
    """
    if decode not in ("none", "to_decode", "to_code"):
        raise InputError("decode is none, to_decode or to_code", decode=decode)
    on = checks or Checks()
    df = x.df if isinstance(x, Dataset) else x
    variables = spec.variables_of(dataset)
    columns = {f.name: f for f in df.schema.fields if not f.name.startswith(SPECIAL)}
    declared = {v["variable"] for v in variables}
    plan = _Plan()
    for v in variables:
        if v["variable"] in columns:
            _count(plan, v, columns[v["variable"]], spec, decode)
    plan.run(df)
    bad: dict[str, tuple[Column, Column]] = {}
    for v in variables:
        n, got = v["variable"], plan.got
        if n in columns and not got.get(f"{n}:utf8"):
            c, kind = F.col(f"`{n}`"), storage(columns[n].dataType)
            if got.get(f"{n}:iso") and on.iso8601_format:
                bad[f"{n}:iso"] = (c, ~iso_ok(c, v["data_type"]))
            if got.get(f"{n}:list"):
                terms, extended = terms_of(spec, v, decode)
                if on.codelist_membership_extensible if extended else on.codelist_membership:
                    text = code_text(c, "double" if kind == "double" and not isinstance(columns[n].dataType, T.LongType) else "text")
                    bad[f"{n}:list"] = (text, outside(text, terms, mandatory(v)))
    seen = offenders(df, bad)

    found: list[Finding] = []
    for v in variables:
        if v["variable"] not in columns:
            if mandatory(v) and on.missing_variable:
                found.append(finding("missing_variable", "mandatory variable is not in the data", dataset, v["variable"]))
            elif not mandatory(v) and on.missing_permissible:
                found.append(finding("missing_permissible", "permissible variable is not in the data", dataset, v["variable"]))
    if on.extra_variable:
        found += [finding("extra_variable", "column is not in the specification", dataset, n) for n in columns if n not in declared]
    if on.variable_name:
        found += [finding("variable_name", f"name {name_problem(n)}", dataset, n) for n in columns if name_problem(n)]
    if on.dataset_name and name_problem(dataset):
        found.append(finding("dataset_name", f"name {name_problem(dataset)}", dataset))
    for v in variables:
        if v["variable"] in columns:
            found += _found(plan.got, seen, v, columns[v["variable"]], spec, dataset, decode, on)
    keys = spec.keys(dataset)
    if on.key_uniqueness and keys and all(k in columns for k in keys):
        n = duplicated_rows(df, keys)
        if n:
            found.append(finding("key_uniqueness", f"{n} rows share their key ({', '.join(keys)}) with another", dataset))
    return found


def _count(plan: _Plan, v: Row, f: T.StructField, spec: Spec, decode: str) -> None:
    """Add the aggregates that a variable's checks need."""
    n, c, kind, want = v["variable"], F.col(f"`{v['variable']}`"), storage(f.dataType), v["data_type"]
    if kind == "character":
        plan.add(f"{n}:utf8", F.count_if(~F.is_valid_utf8(c)))
        plan.add(f"{n}:bytes", F.max(F.octet_length(c)))
        if want in TEMPORAL:
            plan.add(f"{n}:iso", F.count_if(~iso_ok(c, want)))
    if want == "integer" and not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        d = F.expr(f"try_cast(`{n}` as double)") if kind == "character" else c.cast("double")
        if kind in ("character", "double"):
            plan.add(f"{n}:fraction", F.count_if(finite(d) & (d % 1 != 0)))
            plan.add(f"{n}:overflow", F.count_if(finite(d) & (F.abs(d) > INT_MAX)))
    if not blank(v["codelist_id"]):
        terms, _ = terms_of(spec, v, decode)
        text = code_text(c, "double" if kind == "double" and not isinstance(f.dataType, T.LongType) else "text")
        plan.add(f"{n}:list", F.count_if(outside(text, terms, mandatory(v))))


def _found(got: dict[str, int], seen: dict, v: Row, f: T.StructField, spec: Spec, dataset: str, decode: str, on: Checks) -> list[Finding]:
    n, kind, want = v["variable"], storage(f.dataType), v["data_type"]
    out: list[Finding] = []
    add = lambda check, text: getattr(on, check) and out.append(finding(check, text, dataset, n))
    if got.get(f"{n}:utf8"):
        add("invalid_encoding", f"{got[f'{n}:utf8']} values are not valid UTF-8")
        return out
    if kind != WANTED[want] and not (kind == "character" and want in TEMPORAL):
        add("type_mismatch", f"column is stored as {kind}, {want} asks for {WANTED[want]}")
    if f"{n}:iso" in seen:
        add("iso8601_format", f"{got[f'{n}:iso']} values are not ISO 8601 text of a {want}: {', '.join(seen[f'{n}:iso'][1])}")
    size = got.get(f"{n}:bytes", 0)
    if kind == "character" and v["length"] is not None and size > v["length"]:
        add("length_overflow", f"longest value has {size} bytes, length is {v['length']}")
    if size > TEXT_LIMIT:
        add("char_length_limit", f"longest value has {size} bytes, a transport file holds {TEXT_LIMIT}")
    if got.get(f"{n}:fraction"):
        add("integer_fraction", f"{got[f'{n}:fraction']} values have a fraction")
    if got.get(f"{n}:overflow"):
        add("integer_overflow", f"{got[f'{n}:overflow']} values are beyond 32 bits")
    label = (f.metadata or {}).get("label")
    if label is not None and len(label.encode()) > LABEL_LIMIT:
        add("label_length", f"label has {len(label.encode())} bytes, a transport file holds {LABEL_LIMIT}")
    if label is not None and not blank(v["label"]) and label != v["label"]:
        add("label_match", f"label is {label!r}, the specification says {v['label']!r}")
    if f"{n}:list" in seen:
        count, sample = seen[f"{n}:list"]
        check = "codelist_membership_extensible" if terms_of(spec, v, decode)[1] else "codelist_membership"
        add(check, f"{count} distinct values are outside codelist {v['codelist_id']}: {', '.join(sample)}")
    if want in TEMPORAL and not blank(v["display_format"]) and family(v["display_format"]) != want:
        add("display_format", f"{v['display_format']} is no {want} format")
    return out


def check_study(data: dict[str, DataFrame | Dataset], spec: Spec, decode: str = "none", checks: Checks | None = None) -> list[Finding]:
    """Findings of several datasets, one after the other in the specification's order."""
    unknown = [d for d in data if d not in spec.dataset_names()]
    if unknown:
        raise InputError(f"not in the specification: {', '.join(unknown)}", datasets=unknown)
    return reduce(lambda a, b: a + b, (check_spec(data[d], spec, d, decode, checks) for d in spec.dataset_names() if d in data), [])


def study_matrix(findings: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """How often each check fires in each dataset: a row for each dataset, a column for each check."""
    g = findings.groupBy("dataset")
    return (g.pivot("check", checks) if checks else g.pivot("check")).count().na.fill(0)
