"""The specification: small tables on the driver that say what datasets should be."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .errors import InputError, SpecError
from .types import DATA_TYPES, TARGET_TYPES, canonical_type

Row = dict[str, Any]

#: Columns of each slot and their kind; those that each row must fill come first.
SLOTS: dict[str, tuple[tuple[str, ...], dict[str, type]]] = {
    "datasets": (("dataset",), {"dataset": str, "label": str, "class": str, "subclass": str, "structure": str, "keys": str, "comment_id": str}),
    "variables": (
        ("dataset", "variable", "data_type"),
        {
            "dataset": str, "variable": str, "itemoid": str, "label": str, "data_type": str, "target_data_type": str,
            "length": int, "display_format": str, "informat": str, "key_sequence": int, "order": int, "codelist_id": str,
            "method_id": str, "comment_id": str, "mandatory": bool, "significant_digits": int, "origin": str,
            "source": str, "predecessor": str, "assigned_value": str, "pages": str, "role": str,
        },
    ),
    "codelists": (("codelist_id", "term"), {"codelist_id": str, "term": str, "decode": str, "order": int, "extended": bool, "comment_id": str}),
    "methods": (("method_id",), {"method_id": str, "name": str, "type": str, "description": str, "expression_context": str, "expression_code": str, "document_id": str, "pages": str}),
    "comments": (("comment_id",), {"comment_id": str, "description": str, "document_id": str, "pages": str}),
    "documents": (("document_id",), {"document_id": str, "title": str, "href": str}),
}
#: Other names of the study's fields.
STUDY_NAMES = {
    "study_name": ("study_name", "studyname", "study", "name"),
    "study_description": ("study_description", "studydescription", "description"),
    "protocol_name": ("protocol_name", "protocolname", "protocol"),
}

_TRUE, _FALSE = ("TRUE", "T", "YES", "Y", "1"), ("FALSE", "F", "NO", "N", "0")


def blank(x: Any) -> bool:
    """Whether a cell is missing or holds white space alone."""
    return x is None or isinstance(x, float) and x != x or isinstance(x, str) and not x.strip(" \t\r\n")


def split_keys(text: str | None) -> list[str]:
    """Names separated by white space or commas."""
    return [k for k in re.split(r"[\s,]+", text or "") if k]


def rows_of(table: Any) -> list[Row]:
    """Rows of a table given as a DataFrame of Spark or pandas, a mapping of columns, or rows."""
    if table is None:
        return []
    if isinstance(table, DataFrame):
        return [r.asDict() for r in table.collect()]
    if hasattr(table, "to_dict") and hasattr(table, "columns"):
        return table.astype(object).where(table.notna(), None).to_dict("records")
    if isinstance(table, Mapping):
        n = {len(v) for v in table.values()}
        if len(n) > 1:
            raise InputError("columns of a table differ in length")
        return [dict(zip(table, r, strict=True)) for r in zip(*table.values(), strict=True)]
    return [dict(r) for r in table]


def _cell(value: Any, kind: type, slot: str, column: str) -> Any:
    if value is None or isinstance(value, float) and value != value:
        return None
    if kind is str:
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    if kind is bool:
        if isinstance(value, bool):
            return value
        text = str(value).strip().upper()
        if not text:
            return None
        if text not in _TRUE + _FALSE:
            raise SpecError(f"{slot}.{column}: {value!r} is neither yes nor no", slot=slot, column=column)
        return text in _TRUE
    try:
        if isinstance(value, str) and not value.strip():
            return None
        number = float(value)
        if not number.is_integer():
            raise ValueError
        return int(number)
    except (TypeError, ValueError):
        raise SpecError(f"{slot}.{column}: {value!r} is no whole number", slot=slot, column=column) from None


def _slot(name: str, table: Any) -> list[Row]:
    """Rows with all known columns, cells of the declared kinds, and unknown columns as they are."""
    required, columns = SLOTS[name]
    rows = []
    for r in rows_of(table):
        missing = [c for c in required if c not in r]
        if missing:
            raise SpecError(f"{name} lacks the column {', '.join(missing)}", slot=name, columns=missing)
        rows.append({c: _cell(r.get(c), k, name, c) for c, k in columns.items()} | {c: v for c, v in r.items() if c not in columns})
    return rows


@dataclass(frozen=True)
class Spec:
    """One standard's datasets, variables, codelists and supporting tables. Made by ``make_spec``; never changed."""

    datasets: tuple[Row, ...]
    variables: tuple[Row, ...]
    codelists: tuple[Row, ...] = ()
    methods: tuple[Row, ...] = ()
    comments: tuple[Row, ...] = ()
    documents: tuple[Row, ...] = ()
    values: tuple[Row, ...] = ()
    study: Row = field(default_factory=dict)
    standard: str | None = None

    def __post_init__(self) -> None:
        for slot, (required, columns) in SLOTS.items():
            for r in getattr(self, slot):
                for c in required:
                    if r.get(c) is None:
                        raise SpecError(f"{slot}: a row has no {c}", slot=slot, column=c)
                for c, k in columns.items():
                    if r[c] is not None and type(r[c]) is not k:
                        raise SpecError(f"{slot}.{c} holds {r[c]!r}", slot=slot, column=c)
        bad = sorted({v["data_type"] for v in self.variables} - set(DATA_TYPES))
        if bad:
            raise SpecError(f"unknown data types: {', '.join(bad)}", data_types=bad)
        bad = sorted({v["target_data_type"] for v in self.variables} - {None, *TARGET_TYPES})
        if bad:
            raise SpecError(f"unknown target data types: {', '.join(bad)}", data_types=bad)
        twice = [k for k, n in Counter((v["dataset"], v["variable"]) for v in self.variables).items() if n > 1]
        if twice:
            raise SpecError("variables defined more than once: " + ", ".join(".".join(k) for k in twice), pairs=twice)
        known = {d["dataset"] for d in self.datasets}
        orphans = sorted({v["dataset"] for v in self.variables} - known)
        if orphans:
            raise SpecError("variables of datasets that aren't defined: " + ", ".join(orphans), datasets=orphans)
        lists = {c["codelist_id"] for c in self.codelists}
        open_ids = sorted({v["codelist_id"] for v in self.variables if not blank(v["codelist_id"])} - lists)
        if open_ids:
            raise SpecError("codelists that aren't defined: " + ", ".join(open_ids), codelists=open_ids)

    # -- reading it --------------------------------------------------------

    def check_dataset(self, dataset: str) -> str:
        if dataset not in {d["dataset"] for d in self.datasets}:
            raise InputError(f"{dataset!r} is no dataset of the specification; it has {', '.join(d['dataset'] for d in self.datasets)}", dataset=dataset)
        return dataset

    def dataset_names(self) -> list[str]:
        return [d["dataset"] for d in self.datasets]

    def dataset(self, dataset: str) -> Row:
        self.check_dataset(dataset)
        return next(d for d in self.datasets if d["dataset"] == dataset)

    def variables_of(self, dataset: str | None = None) -> list[Row]:
        if dataset is None:
            return list(self.variables)
        self.check_dataset(dataset)
        return [v for v in self.variables if v["dataset"] == dataset]

    def variable(self, dataset: str, variable: str) -> Row | None:
        return next((v for v in self.variables_of(dataset) if v["variable"] == variable), None)

    def codelist(self, codelist_id: str | None = None) -> list[Row]:
        if codelist_id is None:
            return list(self.codelists)
        found = [c for c in self.codelists if c["codelist_id"] == codelist_id]
        if not found:
            raise InputError(f"no codelist {codelist_id!r}", codelist=codelist_id)
        return found

    def keys(self, dataset: str) -> list[str]:
        return split_keys(self.dataset(dataset)["keys"])

    def study_field(self, name: str | None = None) -> Any:
        if name is None:
            return dict(self.study)
        if name not in self.study:
            raise InputError(f"the study has no field {name!r}", field=name)
        return self.study[name]

    def ordered(self, dataset: str) -> list[Row]:
        """Variables by their order, then, in table order, those without one."""
        own = self.variables_of(dataset)
        return [v for _, v in sorted(enumerate(own), key=lambda x: (x[1]["order"] is None, x[1]["order"] or 0, x[0]))]

    def __str__(self) -> str:
        lines = [f"specification {self.standard or 'of no standard'}: {len(self.datasets)} datasets, {len(self.variables)} variables, {len({c['codelist_id'] for c in self.codelists})} codelists"]
        lines += [f"  {d['dataset']}: {len(self.variables_of(d['dataset']))} variables, keys {d['keys'] or 'none'}" for d in self.datasets]
        return "\n".join(lines)


def is_spec(x: Any) -> bool:
    return isinstance(x, Spec)


def _study(table: Any) -> Row:
    """The one study row under its canonical names; two columns of one meaning must agree."""
    rows = [dict(table)] if isinstance(table, Mapping) and not any(isinstance(v, (list, tuple)) for v in table.values()) else rows_of(table)
    if len(rows) > 1:
        raise SpecError("the study table has more than one row")
    out: Row = {}
    for c, v in (rows[0] if rows else {}).items():
        key = re.sub(r"\s+", "", c).lower()
        name = next((n for n, names in STUDY_NAMES.items() if key in names), c)
        if not blank(out.get(name)) and not blank(v) and str(out[name]) != str(v):
            raise SpecError(f"study columns for {name} disagree: {out[name]!r} and {v!r}", field=name)
        if name not in out or blank(out[name]):
            out[name] = v
    return out


def _with_keys(datasets: list[Row], variables: list[Row]) -> list[Row]:
    """Key sequences from a dataset's keys where none of its variables has one."""
    given = {v["dataset"] for v in variables if v["key_sequence"] is not None}
    place = {(d["dataset"], k): i for d in datasets if d["dataset"] not in given for i, k in reversed(list(enumerate(split_keys(d["keys"]), 1)))}
    return [v | {"key_sequence": v["key_sequence"] if v["dataset"] in given else place.get((v["dataset"], v["variable"]))} for v in variables]


def _one_standard(given: str | None, *tables: Iterable[Row]) -> str | None:
    found = {given} | {r.get("standard") for t in tables for r in t}
    found = {str(x).strip() for x in found if not blank(x)}
    if len(found) > 1:
        raise SpecError("more than one standard: " + ", ".join(sorted(found)), standards=sorted(found))
    return next(iter(found), None)


def make_spec(datasets: Any, variables: Any, codelists: Any = None, methods: Any = None, comments: Any = None, documents: Any = None, values: Any = None, study: Any = None, standard: str | None = None) -> Spec:
    """Build and check a specification from tables of any kind that ``rows_of`` reads."""
    d, v = _slot("datasets", datasets), _slot("variables", variables)
    v = [r | {"data_type": canonical_type(r["data_type"])} for r in v]
    s = _study(study)
    return Spec(
        datasets=tuple(d),
        variables=tuple(_with_keys(d, v)),
        codelists=tuple(_slot("codelists", codelists)),
        methods=tuple(_slot("methods", methods)),
        comments=tuple(_slot("comments", comments)),
        documents=tuple(_slot("documents", documents)),
        values=tuple(rows_of(values)),
        study={k: x for k, x in s.items() if k != "standard"},
        standard=_one_standard(standard, [s], d),
    )


def set_type(spec: Spec, dataset: str, **types: str) -> Spec:
    """The specification with other data types for some variables of a dataset."""
    spec.check_dataset(dataset)
    unknown = [v for v in types if spec.variable(dataset, v) is None]
    if unknown:
        raise InputError(f"{dataset} has no variable {', '.join(unknown)}", variables=unknown)
    new = {v: canonical_type(t) for v, t in types.items()}
    return replace(spec, variables=tuple(v | {"data_type": new[v["variable"]]} if v["dataset"] == dataset and v["variable"] in new else v for v in spec.variables))


def repair_spec(spec: Spec, findings: Iterable[Any]) -> Spec:
    """Integer variables whose data turned out fractional or too large become float."""
    hit = {(f.dataset, f.variable) for f in findings if f.check in ("integer_fraction", "integer_overflow")}
    by: dict[str, dict[str, str]] = {}
    for d, v in sorted(hit):
        if spec.variable(d, v) and spec.variable(d, v)["data_type"] == "integer":
            by.setdefault(d, {})[v] = "float"
    for d, types in by.items():
        spec = set_type(spec, d, **types)
    return spec
