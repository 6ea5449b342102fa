"""Metadata of one dataset: what a file says about its columns, in memory and as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InputError, inform
from .spec import Spec
from .types import DATA_TYPES, SPARK_TYPES, TARGET_TYPES, TEMPORAL, inferred_type

#: Attributes of a column and of a dataset, in the order they are written.
COLUMN_FIELDS = ("itemOID", "name", "label", "dataType", "targetDataType", "length", "displayFormat", "informat", "keySequence", "codelist", "significantDigits", "origin")
DATASET_FIELDS = ("itemGroupOID", "name", "label", "records", "studyOID", "metaDataVersionOID", "encoding", "keys")
_WHOLE = ("length", "keySequence", "significantDigits")
#: Attributes that the exchange standard has no place for, and the map each is written to.
_EXTRA = {"informat": "informats", "origin": "origins", "codelist": "codelists", "significantDigits": "significantDigits"}
#: The key of this engine's own block. Any block of a leading underscore that has a version is read.
BLOCK, VERSION = "_veraframe", "metaVersion"
#: Names the companion column that holds a column's special missing values.
SPECIAL = "__sm_"
#: Tags of special missing values; ``.`` is plain missing.
TAGS = ("._", *(f".{chr(c)}" for c in range(65, 91)))


@dataclass(frozen=True)
class Meta:
    """``dataset`` attributes and ``columns`` by name, in order. Absent attributes are left out, never null."""

    dataset: dict[str, Any]
    columns: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for n, c in self.columns.items():
            if c.get("name") != n or c.get("dataType") not in DATA_TYPES:
                raise InputError(f"column {n}: bad name or data type", column=n)
            if c.get("targetDataType") not in (None, *TARGET_TYPES):
                raise InputError(f"column {n}: bad target data type", column=n)
            if any(a not in COLUMN_FIELDS or v is None for a, v in c.items()):
                raise InputError(f"column {n}: unknown or null attributes", column=n)
            if any(type(c[a]) is not int for a in _WHOLE if a in c):
                raise InputError(f"column {n}: {', '.join(_WHOLE)} are whole numbers", column=n)
        if any(a not in DATASET_FIELDS or v is None for a, v in self.dataset.items()) or not self.dataset.get("name"):
            raise InputError("dataset: unknown or null attributes, or no name")

    @property
    def keys(self) -> list[str]:
        """Columns with a key sequence, in its order."""
        return [n for n, c in sorted(self.columns.items(), key=lambda x: x[1].get("keySequence", 0)) if "keySequence" in c]

    def only(self, names: list[str]) -> Meta:
        """The metadata of some columns, in the given order; keys are those left."""
        m = replace(self, columns={n: self.columns[n] for n in names if n in self.columns})
        d = {k: v for k, v in self.dataset.items() if k != "keys"}
        return replace(m, dataset=_in_order(d | ({"keys": m.keys} if m.keys else {}), DATASET_FIELDS))

    def with_dataset(self, **attributes: Any) -> Meta:
        return replace(self, dataset=_in_order({k: v for k, v in (self.dataset | attributes).items() if v is not None}, DATASET_FIELDS))

    def schema(self) -> T.StructType:
        """Spark's schema for the columns: text stays text where a temporal column has no numeric target."""
        return T.StructType([T.StructField(n, SPARK_TYPES["string" if is_iso_text(c) else c["dataType"]], metadata=c) for n, c in self.columns.items()])

    def __str__(self) -> str:
        lines = [f"{self.dataset['name']} {self.dataset.get('label', '')}: {len(self.columns)} columns, {self.dataset.get('records', '?')} records"]
        return "\n".join(lines + [f"  {n} {c['dataType']}{f'({c['length']})' if 'length' in c else ''} {c.get('label', '')}" for n, c in self.columns.items()])


def is_meta(x: Any) -> bool:
    return isinstance(x, Meta)


def is_iso_text(column: dict[str, Any]) -> bool:
    """Whether a temporal column is kept as text, which only a numeric target type changes."""
    return column["dataType"] in TEMPORAL and "targetDataType" not in column


def _in_order(x: dict[str, Any], order: tuple[str, ...]) -> dict[str, Any]:
    return {k: x[k] for k in order if k in x}


def column_from_spec(v: dict[str, Any]) -> dict[str, Any]:
    """A column's attributes from a row of the specification's variables."""
    c = {
        "itemOID": v["itemoid"] or f"IT.{v['dataset']}.{v['variable']}", "name": v["variable"], "label": v["label"],
        "dataType": v["data_type"], "targetDataType": v["target_data_type"], "length": v["length"],
        "displayFormat": v["display_format"], "informat": v["informat"], "keySequence": v["key_sequence"],
        "codelist": v["codelist_id"], "significantDigits": v["significant_digits"], "origin": v["origin"],
    }
    return {k: x for k, x in c.items() if x is not None}


def meta_from_spec(spec: Spec, dataset: str, records: int | None = None) -> Meta:
    d = spec.dataset(dataset)
    columns = {v["variable"]: column_from_spec(v) for v in spec.ordered(dataset)}
    m = Meta({"name": dataset}, columns)
    study = spec.study.get("study_name")
    return m.with_dataset(itemGroupOID=f"IG.{dataset}", label=d["label"], records=records, studyOID=str(study) if study else None, keys=m.keys or None)


def column_from_field(f: T.StructField, dataset: str = "DATA") -> dict[str, Any]:
    """A column's attributes from its Spark type and what its metadata say; temporal types have a numeric target."""
    kind = inferred_type(f.dataType)
    c = {"itemOID": f"IT.{dataset}.{f.name}", "name": f.name, "dataType": kind}
    if kind in TEMPORAL:
        c["targetDataType"] = "integer"
    return _in_order(c | {k: v for k, v in (f.metadata or {}).items() if k in COLUMN_FIELDS and k != "name"}, COLUMN_FIELDS)


def meta_from_frame(df: DataFrame, name: str = "DATA") -> Meta:
    columns = {f.name: column_from_field(f, name) for f in df.schema.fields if not f.name.startswith(SPECIAL)}
    m = Meta({"name": name}, columns)
    return m.with_dataset(itemGroupOID=f"IG.{name}", keys=m.keys or None)


def resolve_targets(meta: Meta, df: DataFrame) -> Meta:
    """Numeric targets for temporal columns whose data aren't text."""
    out = {}
    for n, c in meta.columns.items():
        numeric = n in df.columns and not isinstance(df.schema[n].dataType, T.StringType)
        out[n] = _in_order(c | {"targetDataType": "integer"}, COLUMN_FIELDS) if is_iso_text(c) and numeric else c
    return replace(meta, columns=out)


# -- JSON ---------------------------------------------------------------------


def payload(meta: Meta, special: dict[str, Any] | None = None, extensions: bool = True) -> dict[str, Any]:
    """The dataset's metadata as the object that opens an exchange file; what it has no place for goes in one block."""
    maps = {m: {n: c[a] for n, c in meta.columns.items() if a in c} for a, m in _EXTRA.items()}
    columns = [_in_order({"label": ""} | {a: v for a, v in c.items() if a not in _EXTRA}, COLUMN_FIELDS) for c in meta.columns.values()]
    d = _in_order({"label": ""} | {k: v for k, v in meta.dataset.items() if k not in ("keys", "encoding")}, DATASET_FIELDS)
    block: dict[str, Any] = {}
    if extensions:
        block |= {"sourceEncoding": meta.dataset["encoding"]} if "encoding" in meta.dataset else {}
        block |= {k: v for k, v in maps.items() if v}
        block |= {"specialMissings": special} if special else {}
    return {"datasetJSONVersion": "1.1.0", **d, "columns": columns} | ({BLOCK: {VERSION: "1.0", **block}} if block else {})


def to_json(meta: Meta, special: dict[str, Any] | None = None) -> str:
    return json.dumps(payload(meta, special), ensure_ascii=False)


def parse(x: str | dict[str, Any]) -> tuple[Meta, dict[str, Any]]:
    """(metadata, special missing values) from such an object; an empty label is an absent one."""
    p = json.loads(x) if isinstance(x, str) else x
    block = next((v for k, v in p.items() if k.startswith("_") and isinstance(v, dict) and any(a.lower().endswith("metaversion") for a in v)), {})
    columns: dict[str, dict[str, Any]] = {}
    for c in p.get("columns", []):
        extra = {a: block[m][c["name"]] for a, m in _EXTRA.items() if c["name"] in block.get(m, {})}
        known = {k: v for k, v in (c | extra).items() if k in COLUMN_FIELDS and v is not None and not (k == "label" and v == "")}
        columns[c["name"]] = _in_order({k: int(v) if k in _WHOLE else v for k, v in known.items()}, COLUMN_FIELDS)
    d = {k: p[k] for k in DATASET_FIELDS if k in p and p[k] not in (None, "")}
    m = Meta({"name": "DATA"} | d, columns)
    return m.with_dataset(encoding=block.get("sourceEncoding"), keys=m.keys or None), block.get("specialMissings", {})


# -- a frame with its metadata ------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """A DataFrame and its metadata. Companion columns hold special missing values; they follow their rows."""

    df: DataFrame
    meta: Meta
    findings: tuple = ()

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(SPECIAL)]

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> Dataset:
        """A changed frame, its metadata brought in line."""
        return sync_meta(replace(self, df=change(self.df)))


def stamp(df: DataFrame, meta: Meta) -> DataFrame:
    """The frame with each column's attributes in its field's metadata, where joins and selections keep them."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=meta.columns[c]) if c in meta.columns else F.col(f"`{c}`") for c in df.columns])


def get_meta(x: Dataset) -> Meta:
    if not isinstance(x, Dataset):
        raise InputError("a bare frame has no metadata; conform it or use set_meta")
    return x.meta


def set_meta(df: DataFrame | Dataset, meta: Meta) -> Dataset:
    df = df.df if isinstance(df, Dataset) else df
    return Dataset(stamp(df, meta), meta)


def reconcile(meta: Meta, df: DataFrame) -> Meta:
    """Metadata in the order of the frame's columns: those gone are dropped, new ones inferred."""
    fields = {f.name: f for f in df.schema.fields if not f.name.startswith(SPECIAL)}
    new = [n for n in fields if n not in meta.columns]
    if new:
        inform("meta", f"new columns: {', '.join(new)}")
    m = replace(meta, columns={n: meta.columns.get(n) or column_from_field(f, meta.dataset["name"]) for n, f in fields.items()})
    return m.only(list(fields))


def sync_meta(x: Dataset) -> Dataset:
    return replace(x, meta=reconcile(x.meta, x.df))


def as_dataset(x: DataFrame | Dataset, name: str = "DATA") -> Dataset:
    """A dataset as it is, or a bare frame with inferred metadata."""
    return sync_meta(x) if isinstance(x, Dataset) else Dataset(x, meta_from_frame(x, name))
